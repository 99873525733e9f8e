"""DuckDB SQL that states, independently of the Spark code, what each registered
query must return.  Used by the correctness gate (``__spark_entry__.oracle_sql``)."""

from __future__ import annotations

from .fixtures import COLUMNS, DOUBLE_COLUMNS, GEN_CONTRACTS, TABLES  # noqa: F401

PHYSICAL_CASE = """CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint'
  WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"""
FAMILY_CASE = """CASE WHEN data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT') THEN 'integer'
  WHEN data_type IN ('FLOAT','DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'float'
  WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime'
  WHEN data_type = 'DATE' THEN 'date' ELSE 'string' END"""


def semantic_case(name: str = "column_name", base: str = FAMILY_CASE) -> str:
    n = f"lower({name})"
    return f"""CASE WHEN contains({n}, 'email') THEN 'email'
  WHEN contains({n}, 'phone') OR contains({n}, 'mobile') THEN 'phone'
  WHEN contains({n}, 'date') OR contains({n}, 'time') THEN 'date'
  WHEN {n} IN ('id', 'uuid') OR ends_with({n}, '_id') THEN 'uuid'
  WHEN contains({n}, 'url') OR contains({n}, 'link') THEN 'url'
  ELSE ({base}) END"""


def _missing(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in DOUBLE_COLUMNS else f"({c} IS NULL)"


def profile(table: str) -> str:
    cols = COLUMNS[table]
    flags = ", ".join(f"coalesce(bool_or({_missing(c)}), false) AS n{i}" for i, c in enumerate(cols))
    unions = " UNION ALL ".join(f"SELECT {i} AS ord, n{i} AS nullable FROM a" for i in range(len(cols)))
    return f"""WITH a AS (SELECT count(*) AS total_rows, {flags} FROM {table}),
cols AS (SELECT DISTINCT ordinal_position - 1 AS ord, column_name, data_type
         FROM information_schema.columns WHERE table_name = '{table}'),
flags AS ({unions})
SELECT '{table}' AS table_name, CAST(cols.ord AS INTEGER) AS ordinal, cols.column_name,
       {PHYSICAL_CASE} AS physical_type, {semantic_case()} AS semantic_type,
       flags.nullable, (SELECT total_rows FROM a) AS total_rows
FROM cols JOIN flags ON cols.ord = flags.ord"""


def _catalog_sql() -> str:
    names = ", ".join(f"'{t}'" for t in TABLES)
    return f"""SELECT DISTINCT table_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name,
  {PHYSICAL_CASE} AS physical_type, {semantic_case()} AS semantic_type
FROM information_schema.columns WHERE table_name IN ({names})"""


def contract_catalog() -> str:
    return _catalog_sql()


def detect_keys_all() -> str:
    names = " UNION ALL ".join(f"SELECT '{t}' AS table_name" for t in TABLES)
    return f"""WITH cat AS ({_catalog_sql()}),
cand AS (SELECT table_name, column_name, ordinal,
   CASE WHEN lower(semantic_type) = 'uuid' THEN 1 WHEN lower(column_name) = 'id' THEN 2
        WHEN ends_with(lower(column_name), '_id') THEN 3 END AS priority FROM cat),
best AS (SELECT table_name, column_name AS primary_key,
   row_number() OVER (PARTITION BY table_name ORDER BY priority, ordinal) AS rn
   FROM cand WHERE priority IS NOT NULL)
SELECT t.table_name, b.primary_key FROM ({names}) t LEFT JOIN best b
  ON t.table_name = b.table_name AND b.rn = 1"""


def candidate_keys_conversations() -> str:
    parts = []
    for c in COLUMNS["conversations"]:
        parts.append(f"""SELECT '{c}' AS column_name, count(*) AS total_rows,
  (count(DISTINCT {c}) = count(*) AND count({c}) = count(*)) AS is_unique FROM conversations""")
    return " UNION ALL ".join(parts)


def key_quality(table: str, pk: str, null_expr: str | None = None) -> str:
    k = null_expr or pk
    blank = f" OR CAST({k} AS VARCHAR) = ''" if null_expr else ""
    return f"""SELECT '{pk}' AS primary_key_column,
  count(*) - count(DISTINCT {k}) - CAST(max(CASE WHEN {k} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicates_found,
  count(*) FILTER (WHERE {k} IS NULL{blank}) AS nulls_found,
  (count(*) - count(DISTINCT {k}) - CAST(max(CASE WHEN {k} IS NULL THEN 1 ELSE 0 END) AS BIGINT) = 0
   AND count(*) FILTER (WHERE {k} IS NULL{blank}) = 0) AS is_valid
FROM {table}"""


ORACLES: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLES[name] = sql


for _t in ("customer", "orders", "documents", "events"):
    register(f"profile_{_t}", profile(_t))
register("contract_catalog", " UNION ALL ".join(f"SELECT * FROM ({profile(t)})" for t in TABLES))


def _detect_and_verify() -> str:
    quality = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, * FROM ({key_quality(t, c)})" for t in TABLES for c in COLUMNS[t])
    return f"""SELECT d.table_name, d.primary_key, q.duplicates_found, q.nulls_found, q.is_valid
FROM ({detect_keys_all()}) d LEFT JOIN ({quality}) q
  ON d.table_name = q.table_name AND d.primary_key = q.primary_key_column"""


register("detect_keys_all", _detect_and_verify())
register("candidate_keys_conversations", candidate_keys_conversations())
register("key_quality_lineitem", key_quality("lineitem", "l_orderkey"))
register("key_quality_orders", key_quality("orders", "o_orderkey"))
# events with the key blanked on every 7th user: '' and null both count as missing.
register("key_quality_nulls", key_quality(
    "(SELECT CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 7 = 1 THEN '' "
    "ELSE CAST(user_id AS VARCHAR) END AS user_key FROM events) AS e",
    "user_key", null_expr="user_key"))
register("samples_part", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
  CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice
FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10)""")


def profile_with_key(table: str, pk: str) -> str:
    kq = key_quality(table, pk)
    return f"""SELECT p.*, k.* FROM ({profile(table)}) p, ({kq}) k"""


register("profile_key_lineitem", profile_with_key("lineitem", "l_orderkey"))


# --- C: plans --------------------------------------------------------------------
BATCH_CASE = """CASE WHEN num_columns <= 10 THEN 30 WHEN num_columns <= 20 THEN 20
  WHEN num_columns <= 35 THEN 15 WHEN num_columns <= 50 THEN 10 WHEN num_columns <= 75 THEN 7 ELSE 5 END"""


def specs(tables: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS dataset_name, count(*) AS rows, {len(COLUMNS[t])} AS num_columns FROM {t}"
        for t in tables)


def plan(tables: list[str]) -> str:
    return f"""SELECT dataset_name, batch_num, batch_size,
  least(batch_size, rows - (batch_num - 1) * batch_size) AS target_rows,
  (batch_num - 1) * batch_size + 1 AS start_idx,
  (batch_num - 1) * batch_size + least(batch_size, rows - (batch_num - 1) * batch_size) AS end_idx
FROM (SELECT dataset_name, rows, batch_size,
        unnest(range(1, CAST(ceil(rows / batch_size) AS BIGINT) + 1)) AS batch_num
      FROM (SELECT dataset_name, rows, CAST({BATCH_CASE} AS BIGINT) AS batch_size FROM ({specs(tables)})))"""


register("batch_plan_all", plan(TABLES))
register("seed_keys_orders", f"""SELECT dataset_name, batch_num, row_idx, 'O_ORDERKEY-' || row_idx AS seed_key
FROM (SELECT dataset_name, batch_num, unnest(range(start_idx, end_idx + 1)) AS row_idx FROM ({plan(['orders'])}))""")
register("default_text_all", f"""WITH t AS (SELECT table_name AS dataset_name,
  'Realistic synthetic ' || upper(substr(table_name, 1, 1)) || lower(substr(table_name, 2)) || ' dataset'
  || CASE WHEN count(*) > 0 THEN ' containing fields: '
       || string_agg(CASE WHEN ordinal_position <= 6 THEN column_name END, ', ' ORDER BY ordinal_position)
       || CASE WHEN count(*) > 6 THEN ' and ' || (count(*) - 6) || ' more' ELSE '' END || '.'
     ELSE '.' END AS description,
  'Generate realistic, diverse, and internally consistent data. Values must reflect real-world distributions and relationships between columns. Avoid repetitive patterns, placeholder text, or sequential values. Ensure all fields have appropriate formats and plausible value ranges.' AS ai_criteria
FROM (SELECT DISTINCT table_name, ordinal_position, column_name FROM information_schema.columns
      WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}))
GROUP BY table_name)
SELECT s.dataset_name, s.rows, s.num_columns, {BATCH_CASE} AS batch_size, t.description, t.ai_criteria
FROM ({specs(TABLES)}) s JOIN t ON s.dataset_name = t.dataset_name""")

# --- E: replies ------------------------------------------------------------------
CUST_NAME = """CASE c_custkey % 10 WHEN 3 THEN c_name || ', Inc' WHEN 7 THEN c_name || ' "VIP"'
  WHEN 9 THEN c_name || chr(10) || 'line2' ELSE c_name END"""
CUST_NAME_QUOTED = ("CASE c_custkey % 10 WHEN 3 THEN '\"' || c_name || ', Inc\"' "
                    "WHEN 7 THEN '\"' || c_name || ' \"\"VIP\"\"\"' "
                    "WHEN 9 THEN '\"' || c_name || chr(10) || 'line2\"' ELSE c_name END")
register("parse_csv_customer", f"""SELECT c_custkey // 30 AS batch_num, 0 AS attempt,
  CAST(c_custkey AS VARCHAR) AS c_custkey, {CUST_NAME} AS c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""")
register("rejects_customer", f"""SELECT c_custkey // 30 AS batch_num, 3 AS n_fields,
  CAST(c_custkey AS VARCHAR) || ',' || {CUST_NAME_QUOTED} || ',' || CAST(c_nationkey AS VARCHAR) AS record
FROM customer WHERE c_custkey % 17 = 0""")
register("parse_json_events", """SELECT event_id // 20 AS batch_num, 0 AS attempt, event_id, user_id, event_type,
  CASE WHEN event_type <> 'view' THEN value END AS value, props FROM events""")
register("props_union", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
register("reply_status", """SELECT event_id // 20 AS batch_num, 0 AS attempt,
  CAST(CASE WHEN (event_id // 20) % 5 = 3 THEN 0 ELSE count(*) END AS INTEGER) AS rows_parsed,
  CASE WHEN (event_id // 20) % 5 = 3 THEN 'failed' ELSE 'ok' END AS status
FROM events GROUP BY event_id // 20""")

# --- F: cleaning and assembly ----------------------------------------------------
LI_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
            "l_returnflag, l_linestatus, l_shipdate")
register("dedup_lineitem_key", f"""SELECT * FROM lineitem WHERE l_orderkey IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {LI_ORDER}) = 1""")
register("dedup_documents_text", """SELECT doc_id, lang, source, n_chars FROM documents
WHERE text IS NOT NULL AND text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
register("dropped_documents", """SELECT count(*) AS rows_in, count(DISTINCT text) AS rows_kept,
  count(*) - count(DISTINCT text) AS dropped_duplicates FROM documents WHERE text IS NOT NULL AND text <> ''""")
register("exclude_claimed_orders", """SELECT * FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
_KEPT = "SELECT DISTINCT l_orderkey + 1 AS row_idx, (l_orderkey // 30) + 1 AS batch_num FROM lineitem"
register("shortfall_lineitem", f"""WITH p AS ({plan(['orders'])}),
k AS (SELECT batch_num, count(*) AS kept_rows FROM ({_KEPT}) GROUP BY batch_num)
SELECT p.*, CAST(coalesce(k.kept_rows, 0) AS BIGINT) AS kept_rows,
  p.target_rows - coalesce(k.kept_rows, 0) AS shortfall
FROM p LEFT JOIN k ON p.batch_num = k.batch_num""")
register("retry_plan_lineitem", f"""WITH p AS ({plan(['orders'])}),
kept AS ({_KEPT}),
planned AS (SELECT batch_num, unnest(range(start_idx, end_idx + 1)) AS row_idx FROM p),
missing AS (SELECT * FROM planned WHERE row_idx NOT IN (SELECT row_idx FROM kept)),
m AS (SELECT batch_num, count(*) AS target_rows,
        string_agg('O_ORDERKEY-' || row_idx, ',' ORDER BY row_idx) AS seeds FROM missing GROUP BY batch_num),
k AS (SELECT batch_num, count(*) AS kept_rows FROM kept GROUP BY batch_num)
SELECT p.batch_num, 1 AS attempt, m.target_rows, p.start_idx + coalesce(k.kept_rows, 0) AS start_idx,
  p.end_idx, CAST(0.4 AS DOUBLE) AS temperature, m.seeds
FROM p JOIN m ON p.batch_num = m.batch_num LEFT JOIN k ON p.batch_num = k.batch_num""")
register("assemble_union", "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier")
register("trim_to_rows", f"""SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {LI_ORDER}) <= 3""")


# --- D: generation -----------------------------------------------------------------
# The generator re-stated in SQL: draws are the first 60 bits (32 for choices from short
# lists) of md5 over 'seed|column|row|salt'; see the value rules in the generator module.
from .functions import values as _V  # noqa: E402  (word lists are fixed values)

SEED = 42
RANGE_FROM = "(SELECT unnest(range(1, (SELECT count(*) FROM {t}) + 1)) AS i)"
KEYED_FROM = {"customer": "(SELECT c_custkey AS i FROM customer)", "orders": "(SELECT o_orderkey AS i FROM orders)",
              "part": "(SELECT p_partkey AS i FROM part)"}


def _h(col: str, salt: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', '{col}', CAST(i AS VARCHAR), '{salt}'))"


def _chunk(h: str, k: int = 0) -> str:
    return f"('0x' || substr({h}, {1 + 8 * k}, 8))::BIGINT"


def _wide(h: str) -> str:
    return f"('0x' || substr({h}, 1, 15))::BIGINT"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words: list[str], u: str) -> str:
    return f"({_list(words)})[({u}) % {len(words)} + 1]"


def _offset(n: int, dist: str | None, col: str) -> str:
    d = (dist or "uniform").lower()
    if d == "normal":
        terms = " + ".join(_chunk(_h(col, f"g{g}"), k) for g in range(3) for k in range(4))
        return (f"CAST((((({terms})::HUGEINT * 16777216 + {_chunk(_h(col, 'g3'))} % 16777216) * {n}) "
                f"// {12 * 2**56}::HUGEINT) AS BIGINT)")
    if d == "skewed":
        x = f"(CAST({_wide(_h(col, 'v'))} AS DOUBLE) / CAST({2**60} AS DOUBLE))"
        return f"CAST(floor({x} * {x} * {n}) AS BIGINT)"
    return f"({_wide(_h(col, 'r' if d == 'random' else 'v'))} % {n})"


def _gen_value(c: dict) -> str:
    from .spec import DateRange, NumericRange, RegexPattern, parse_pattern
    t, name, dist = c.get("type", "string"), c["name"], c.get("distribution")
    pat = parse_pattern(c.get("pattern"), t)
    if isinstance(pat, RegexPattern) and t in _V.TEXT_TYPES:
        parts = []
        for ti, tok in enumerate(pat.tokens):
            for j in range(tok.max_rep):
                if len(tok.alphabet) == 1:
                    parts.append(f"'{tok.alphabet}'")
                else:
                    u = _chunk(_h(name, f"t{ti}c{j // 4}"), j % 4)
                    parts.append(f"substr('{tok.alphabet}', CAST(({u}) % {len(tok.alphabet)} + 1 AS INTEGER), 1)")
        return " || ".join(parts)
    if t == "integer":
        lo, hi = (int(pat.lo), int(pat.hi)) if isinstance(pat, NumericRange) else _V.DEFAULT_INT_RANGE
        return f"CAST({lo} + {_offset(hi - lo + 1, dist, name)} AS BIGINT)"
    if t == "float":
        scale, lo_c, hi_c = _V.float_grid(pat if isinstance(pat, NumericRange) else None)
        return f"CAST(({lo_c} + {_offset(hi_c - lo_c + 1, dist, name)}) / {scale} AS DOUBLE)"
    if t == "boolean":
        return f"({_chunk(_h(name, 'v'))} % 2 = 0)"
    if t == "date":
        lo, hi = (pat.lo, pat.hi) if isinstance(pat, DateRange) else _V.DEFAULT_DATE_RANGE
        days = (hi.date() - lo.date()).days
        return f"(DATE '{lo.date()}' + CAST({_offset(days + 1, dist, name)} AS INTEGER))"
    if t == "datetime":
        lo, hi = (pat.lo, pat.hi) if isinstance(pat, DateRange) else _V.DEFAULT_DATE_RANGE
        import datetime as _dt
        hi = _dt.datetime.combine(hi.date(), _dt.time(23, 59, 59)) if hi.time() == _dt.time(0, 0) else hi
        secs = int((hi - lo).total_seconds())
        return f"(TIMESTAMP '{lo:%Y-%m-%d %H:%M:%S}' + to_seconds({_offset(secs + 1, dist, name)}))"
    if t == "uuid":
        h = _h(name, "u")
        return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || "
                f"substr('89ab', CAST(('0x' || substr({h}, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || "
                f"substr({h}, 18, 3) || '-' || substr({h}, 21, 12)")
    if t in ("name", "email"):
        h = _h(name, "name")
        first, last = _pick(_V.FIRST_NAMES, _chunk(h, 0)), _pick(_V.LAST_NAMES, _chunk(h, 1))
        if t == "name":
            return f"{first} || ' ' || {last}"
        dom = _pick(_V.DOMAINS, _chunk(h, 2))
        return f"lower({first} || '.' || {last} || CAST(i AS VARCHAR) || '@' || {dom})"
    if t == "phone":
        h = _h(name, "ph")
        return (f"'+1-' || CAST(200 + {_chunk(h, 0)} % 800 AS VARCHAR) || '-' || "
                f"lpad(CAST({_chunk(h, 1)} % 1000 AS VARCHAR), 3, '0') || '-' || "
                f"lpad(CAST({_chunk(h, 2)} % 10000 AS VARCHAR), 4, '0')")
    if t == "address":
        h = _h(name, "addr")
        return (f"CAST(1 + {_chunk(h, 0)} % 9999 AS VARCHAR) || ' ' || {_pick(_V.STREETS, _chunk(h, 1))} || ' ' || "
                f"{_pick(_V.STREET_SUFFIXES, _chunk(h, 2))} || ', ' || {_pick(_V.CITIES, _chunk(h, 3))}")
    if t == "url":
        h = _h(name, "url")
        return (f"'https://' || {_pick(_V.HOSTS, _chunk(h, 0))} || '.' || {_pick(_V.WORDS, _chunk(h, 1))} || '.' || "
                f"{_pick(_V.TLDS, _chunk(h, 2))} || '/' || {_pick(_V.WORDS, _chunk(h, 3))} || '/' || CAST(i AS VARCHAR)")
    return _pick(_V.WORDS, _offset(len(_V.WORDS), dist, name))


def gen_sql(columns: list[dict], pk: str | None = None, table: str = "customer", null_rate: int = 5,
            keyed: bool = False) -> str:
    exprs = []
    for c in columns:
        if pk and c["name"] == pk:
            v = f"'{pk.replace(' ', '').upper()}-' || CAST(i AS VARCHAR)"
        else:
            v = _gen_value(c)
            if c.get("nullable"):
                from .spec import ColumnContract
                salt, k = _V.null_source(ColumnContract.from_dict(c))
                v = f"CASE WHEN {_chunk(_h(c['name'], salt), k)} % 100 >= {null_rate} THEN {v} END"
        exprs.append(f"{v} AS {c['name']}")
    rows = KEYED_FROM[table] if keyed else RANGE_FROM.format(t=table)
    return f"SELECT i AS row_idx, {', '.join(exprs)} FROM {rows}"


def _register_gen():
    from .fixtures import customer_profile
    for name, cols in GEN_CONTRACTS.items():
        register(name, gen_sql(cols, keyed=True))
    register("gen_users", gen_sql([c.to_dict() for c in customer_profile()], pk="customer_id", keyed=True))


_register_gen()


def _mimic_segment_sql(source: str) -> str:
    return f"""WITH src AS ({source}),
f AS (SELECT value, count(*) AS freq FROM src GROUP BY 1),
iv AS (SELECT value, freq, sum(freq) OVER (ORDER BY value NULLS FIRST ROWS UNBOUNDED PRECEDING) AS hi FROM f),
g AS (SELECT i, {_wide(_h('c_mktsegment', 'v'))} % (SELECT count(*) FROM src) AS r FROM {KEYED_FROM['customer']})
SELECT g.i AS row_idx, iv.value AS c_mktsegment FROM g JOIN iv ON g.r >= iv.hi - iv.freq AND g.r < iv.hi"""


register("mimic_segment", _mimic_segment_sql("SELECT c_mktsegment AS value FROM customer"))
register("mimic_nullable", _mimic_segment_sql(
    "SELECT CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS value FROM customer"))
_PART_ALL = " AND ".join(f"s.{c} IS NOT DISTINCT FROM p.{c}" for c in COLUMNS["part"])
register("novel_rows", f"""SELECT * FROM part p WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10) s WHERE {_PART_ALL})""")
register("sample_copies_part", f"""SELECT * FROM part p WHERE EXISTS (
  SELECT 1 FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10) s WHERE {_PART_ALL})""")

for _name, _not in (("sample_copies_orders", ""), ("novel_rows_orders", "NOT ")):
    register(_name, f"""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o WHERE {_not}EXISTS (
  SELECT 1 FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10) s
  WHERE s.o_custkey IS NOT DISTINCT FROM o.o_custkey AND s.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus)""")


# --- G: validation -------------------------------------------------------------------
from .fixtures import VALIDATE_CONTRACTS  # noqa: E402


def _v_text(col: str, typ: str) -> str:
    if col in ("l_shipdate", "o_orderdate", "ts"):
        return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({col} AS VARCHAR)"


# The validator's rules, restated: what a present value of a type looks like.
_LOOKS_LIKE = {
    "integer": "regexp_full_match({t}, '-?[0-9]+')",
    "float": "regexp_full_match({t}, '-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?')",
    "boolean": "lower({t}) IN ('true', 'false')",
    "date": "(regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST({t} AS DATE) IS NOT NULL)",
    "datetime": "(TRY_CAST({t} AS TIMESTAMP) IS NOT NULL)",
    "email": "regexp_full_match({t}, '[^@ ]+@[^@ ]+[.][^@ ]+')",
    "phone": "regexp_full_match({t}, '[+]?[0-9][0-9 ().-]{{5,}}[0-9]')",
    "uuid": "regexp_full_match({t}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')",
    "url": "regexp_full_match({t}, 'https?://[A-Za-z0-9.-]+(:[0-9]+)?([/?#][^ ]*)?')",
}
_PLACEHOLDERS = ["lorem", "ipsum", "test", "n/a", "xxx", "todo", "tbd", "placeholder", "dummy", "asdf"]


def _pattern_sql(t: str, pattern: str) -> str:
    """A contract pattern as a condition: lo-hi, one day to another, or a regex."""
    import re
    if m := re.fullmatch(r"(-?[0-9.]+)-(-?[0-9.]+)", pattern):
        return f"(TRY_CAST({t} AS DOUBLE) BETWEEN {m[1]} AND {m[2]})"
    if m := re.fullmatch(r"([0-9-]+) to ([0-9-]+)", pattern):
        return f"(TRY_CAST({t} AS TIMESTAMP) BETWEEN TIMESTAMP '{m[1]}' AND TIMESTAMP '{m[2]} 23:59:59.999999')"
    return f"regexp_full_match({t}, '{pattern}')"


def validate_sql(table: str) -> str:
    parts = []
    for c in VALIDATE_CONTRACTS[table]:
        name, typ = c["name"], c.get("type", "string")
        t = _v_text(name, typ)
        miss = f"({t} IS NULL OR {t} = '')"
        if not c.get("nullable"):
            parts.append(f"SELECT 'not_null' AS check_name, '{name}' AS column_name, count(*) FILTER (WHERE {miss}) AS violations FROM {table}")
        if typ in _LOOKS_LIKE:
            parts.append(f"SELECT 'type_format', '{name}', count(*) FILTER (WHERE NOT {miss} AND NOT coalesce({_LOOKS_LIKE[typ].format(t=t)}, false)) FROM {table}")
        if c.get("pattern"):
            parts.append(f"SELECT 'pattern', '{name}', count(*) FILTER (WHERE NOT {miss} AND NOT coalesce({_pattern_sql(t, c['pattern'])}, false)) FROM {table}")
    return " UNION ALL ".join(parts)


register("validate_customer", validate_sql("customer"))
register("validate_pages_url", validate_sql("pages"))
register("validate_ranges", validate_sql("lineitem"))
register("row_uniqueness_documents", """SELECT lang, source, md5(text) AS text_md5, count(*) AS copies
FROM documents GROUP BY lang, source, text HAVING count(*) > 1""")


def _gaps(keys_sql: str) -> str:
    return f"""SELECT prev_key, key, key - prev_key AS gap FROM (
  SELECT k AS key, lag(k) OVER (ORDER BY k) AS prev_key FROM (SELECT DISTINCT k FROM ({keys_sql}) WHERE k IS NOT NULL))
WHERE prev_key IS NOT NULL AND key - prev_key <> 1"""


register("key_continuity_lineitem", _gaps("SELECT l_orderkey AS k FROM lineitem"))
register("key_continuity_orders", _gaps("SELECT o_orderkey AS k FROM orders"))
register("key_continuity_seeded", _gaps(
    "SELECT row_idx AS k FROM (SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS row_idx) "
    "WHERE row_idx IN (SELECT l_orderkey + 1 FROM lineitem)"))
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM part"
                           for c in COLUMNS["part"])
register("low_variety_part", f"""WITH c AS (SELECT column_name, value, count(*) AS cnt FROM ({_LONG})
   WHERE value IS NOT NULL GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn,
        CAST(sum(cnt) OVER (PARTITION BY column_name) AS BIGINT) AS total FROM c)
SELECT column_name, value AS top_value, cnt AS top_count, total, cnt / total AS top_share FROM r WHERE rn = 1""")

_LONG_DOCS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM documents"
                                for c in COLUMNS["documents"])
register("low_variety_documents", f"""WITH c AS (SELECT column_name, value, count(*) AS cnt FROM ({_LONG_DOCS})
   WHERE value IS NOT NULL GROUP BY column_name, value),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn,
        CAST(sum(cnt) OVER (PARTITION BY column_name) AS BIGINT) AS total FROM c)
SELECT column_name, md5(value) AS top_md5, cnt AS top_count, total, cnt / total AS top_share FROM r WHERE rn = 1""")


def _placeholder_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{w}' AS word, count(*) FILTER (WHERE regexp_matches(lower(text), "
        f"'(^|[^a-z0-9_]){w}($|[^a-z0-9_])')) AS rows FROM documents" for w in _PLACEHOLDERS)


register("placeholder_documents", _placeholder_sql())
_HALVES = """WITH m AS (SELECT (min(event_id) + max(event_id)) // 2 AS mid FROM events),
a AS (SELECT event_type AS value, count(*) AS a_count FROM events WHERE event_id <= (SELECT mid FROM m) GROUP BY 1),
b AS (SELECT event_type AS value, count(*) AS b_count FROM events WHERE event_id > (SELECT mid FROM m) GROUP BY 1),
na AS (SELECT count(*) AS n FROM events WHERE event_id <= (SELECT mid FROM m)),
nb AS (SELECT count(*) AS n FROM events WHERE event_id > (SELECT mid FROM m)),
d AS (SELECT coalesce(a.value, b.value) AS value, coalesce(a_count, 0) AS a_count, coalesce(b_count, 0) AS b_count
      FROM a FULL OUTER JOIN b ON a.value IS NOT DISTINCT FROM b.value)"""
register("drift_events", f"""{_HALVES}
SELECT value, a_count, b_count, a_count / (SELECT n FROM na) AS a_share, b_count / (SELECT n FROM nb) AS b_share,
  abs(a_count / (SELECT n FROM na) - b_count / (SELECT n FROM nb)) AS share_diff FROM d""")
register("drift_tvd_events", f"""{_HALVES}
SELECT sum(abs(a_count * (SELECT n FROM nb) - b_count * (SELECT n FROM na))) / (2 * (SELECT n FROM na) * (SELECT n FROM nb)) AS tvd FROM d""")


def _ks_sql(value: str, first: str) -> str:
    return f"""WITH m AS (SELECT (min(event_id) + max(event_id)) // 2 AS mid, min(event_type) AS kind FROM events),
c AS (SELECT {value} AS value, count(*) FILTER (WHERE {first}) AS a, count(*) FILTER (WHERE NOT ({first})) AS b
      FROM events, m WHERE {value} IS NOT NULL GROUP BY 1),
r AS (SELECT value, CAST(sum(a) OVER w AS BIGINT) AS a, CAST(sum(b) OVER w AS BIGINT) AS b FROM c
      WINDOW w AS (ORDER BY value)),
n AS (SELECT max(a) AS na, max(b) AS nb FROM r),
g AS (SELECT value, abs(CAST(a AS HUGEINT) * nb - CAST(b AS HUGEINT) * na) AS gap FROM r, n)
SELECT na AS a_rows, nb AS b_rows, CAST((SELECT max(gap) FROM g) AS DOUBLE) / (CAST(na AS DOUBLE) * nb) AS ks,
  (SELECT min(value) FROM g WHERE gap = (SELECT max(gap) FROM g)) AS at_value FROM n"""


register("drift_ks_events", _ks_sql("value", "event_id <= mid"))
register("drift_ks_event_times", _ks_sql("ts", "event_type = kind"))


# --- H: sinks (a round trip returns the table) ----------------------------------------
for _f in ("csv", "tsv", "json", "parquet"):
    register(f"sink_roundtrip_{_f}", "SELECT * FROM nation")
register("sink_roundtrip_orders_csv", "SELECT * FROM orders")
register("sink_roundtrip_customer_tsv", "SELECT * FROM customer")

# --- I: job ledger ---------------------------------------------------------------------
_JOBS = """SELECT 'job-' || o_custkey AS job_id, o_orderpriority AS dataset_name, CAST(trunc(o_totalprice) AS BIGINT) AS rows,
  (['csv', 'json', 'parquet', 'tsv'])[o_orderkey % 4 + 1] AS format,
  CASE WHEN o_orderkey % 2 = 0 THEN '["id", "name"]' ELSE '["id"]' END AS columns,
  CASE WHEN o_orderkey % 3 = 0 THEN 'output/job-' || o_custkey || '.' || (['csv', 'json', 'parquet', 'tsv'])[o_orderkey % 4 + 1]
       ELSE 'datasets/' || o_orderpriority || '/job-' || o_custkey || '.' || (['csv', 'json', 'parquet', 'tsv'])[o_orderkey % 4 + 1] END AS file_path,
  CASE WHEN o_orderkey % 5 = 0 THEN 'datasets/s3/job-' || o_custkey END AS s3_key,
  CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS generated_at,
  coalesce(CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' END, 'success') AS status,
  CAST(epoch(o_orderdate + to_seconds(o_orderkey)) AS BIGINT) + 7776000 AS ttl,
  o_orderdate + to_seconds(o_orderkey) AS written_at
FROM orders"""
_CURRENT = f"""SELECT * FROM ({_JOBS}) QUALIFY row_number() OVER (PARTITION BY job_id
  ORDER BY written_at DESC, ttl DESC NULLS LAST, file_path DESC NULLS LAST) = 1"""
register("ledger_latest", f"""SELECT job_id, dataset_name, rows, format,
  array_to_string(CAST(columns AS VARCHAR[]), '|') AS columns, file_path, s3_key, generated_at, status
FROM ({_CURRENT}) ORDER BY coalesce(generated_at, '') DESC, job_id LIMIT 10""")
register("ledger_get", f"""SELECT job_id, dataset_name, rows, format,
  array_to_string(CAST(columns AS VARCHAR[]), '|') AS columns, file_path, s3_key, generated_at, status, ttl
FROM ({_CURRENT}) WHERE job_id = 'job-7'""")
register("ledger_resolve", f"""SELECT job_id, CASE WHEN starts_with(coalesce(nullif(s3_key, ''), file_path), 'datasets/')
  THEN coalesce(nullif(s3_key, ''), file_path) END AS artifact FROM ({_CURRENT})""")
register("ledger_unexpired", f"""SELECT job_id, ttl, status FROM ({_CURRENT}) WHERE ttl > 883612800""")
register("ledger_compacted", f"""SELECT * EXCLUDE (written_at) FROM ({_CURRENT})""")
register("ledger_get_compacted", ORACLES["ledger_get"])

# --- J: streaming ------------------------------------------------------------------------
register("stream_replies", f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {CUST_NAME} AS c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""")

register("stream_claims_customer", f"""SELECT c_custkey // 30 AS batch_num, CAST(0 AS INTEGER) AS attempt,
  CAST(c_custkey AS VARCHAR) AS c_custkey, {CUST_NAME} AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  c_mktsegment FROM customer WHERE c_custkey // 30 % 9 <> 0
UNION ALL SELECT c_custkey // 30, 1, CAST(c_custkey AS VARCHAR), c_name || ' again', '99', 'SECOND'
FROM customer WHERE c_custkey // 30 % 9 = 0""")


# --- C5 / C7 --------------------------------------------------------------------------
def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _template_sql(text: str, parts: dict[str, str]) -> str:
    out, rest = [], text
    while rest:
        hits = [(rest.find(p), p) for p in parts if rest.find(p) >= 0]
        if not hits:
            out.append(_sql_lit(rest))
            break
        pos, ph = min(hits)
        if pos:
            out.append(_sql_lit(rest[:pos]))
        out.append(f"({parts[ph]})")
        rest = rest[pos + len(ph):]
    return " || ".join(out)


def _prompt_lengths_sql() -> str:
    from .plans.batches import DEFAULT_CRITERIA
    from .plans.prompts import CRITERIA_PREFIX, CSV_PROMPT, DESCRIPTION_PREFIX, PRESEED_BLOCK, SAMPLE_HEADER
    lines = ["  c_custkey (integer, NOT NULL, PRIMARY KEY)", "  c_name (string, NOT NULL)",
             "  c_nationkey (integer, NOT NULL)", "  c_acctbal (float, NOT NULL)",
             "  c_mktsegment (string, NOT NULL)"]
    cols = COLUMNS["customer"]
    const = {"{dataset_name}": "customer",
             "{description_block}": DESCRIPTION_PREFIX + "Realistic synthetic Customer dataset containing fields: "
             + ", ".join(cols) + ".",
             "{criteria_block}": CRITERIA_PREFIX + DEFAULT_CRITERIA,
             "{num_cols}": "5", "{col_defs}": "\n".join(lines), "{pk_label}": "c_custkey",
             "{col_names}": ", ".join(cols)}
    text = CSV_PROMPT
    for k, v in const.items():
        text = text.replace(k, v)
    samples = (f"(SELECT {_sql_lit(SAMPLE_HEADER)} || string_agg(CAST(c_custkey AS VARCHAR) || ',' || c_name || ',' || "
               "CAST(c_nationkey AS VARCHAR) || ',' || CAST(c_acctbal AS VARCHAR) || ',' || c_mktsegment, chr(13) || chr(10) "
               "ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5))")
    keys = ("'[' || (SELECT string_agg('\"C_CUSTKEY-' || k || '\"', ', ' ORDER BY k) "
            "FROM (SELECT unnest(range(start_idx, end_idx + 1)) AS k)) || ']'")
    preseed = _template_sql(PRESEED_BLOCK.replace("{pk}", "c_custkey"),
                            {"{n}": "CAST(end_idx - start_idx + 1 AS VARCHAR)", "{keys_json}": keys})
    body = _template_sql(text, {"{rows}": "CAST(target_rows AS VARCHAR)",
                                "{rows_minus_1}": "CAST(target_rows - 1 AS VARCHAR)",
                                "{rows_plus_1}": "CAST(target_rows + 1 AS VARCHAR)",
                                "{start}": "CAST(start_idx AS VARCHAR)", "{end}": "CAST(end_idx AS VARCHAR)",
                                "{preseed_block}": preseed, "{sample_block}": samples})
    return f"""SELECT batch_num, CAST(length(p) AS INTEGER) AS prompt_length, md5(p) AS prompt_md5
FROM (SELECT batch_num, {body} AS p FROM ({plan(['customer'])}))"""


register("prompt_lengths", _prompt_lengths_sql())
register("complete_prompts_orders", f"""SELECT batch_num, 'ORDER_KEY-' || k AS order_key,
  CAST(length('ORDER_KEY-' || k) AS VARCHAR) AS key_len
FROM (SELECT batch_num, unnest(range(start_idx, end_idx + 1)) AS k FROM ({plan(['orders'])}))
WHERE batch_num % 13 <> 0""")
register("completion_errors_orders", f"""SELECT batch_num, 0 AS attempt, 'RuntimeError: service unavailable' AS error
FROM ({plan(['orders'])}) WHERE batch_num % 13 = 0""")


# --- A: sources ----------------------------------------------------------------------------
_SEMI = "concat_ws(';', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_mktsegment)"
register("delimiter_counts", " UNION ALL ".join(
    f"""SELECT '{d}' AS delimiter, min(n) AS min_count, max(n) AS max_count, count(*) AS total_lines,
  (min(n) = max(n) AND min(n) > 0) AS consistent, {chosen} AS chosen
FROM (SELECT CAST(length(line) - length(replace(line, '{d}', '')) AS INTEGER) AS n
      FROM (SELECT {_SEMI} AS line FROM customer) WHERE length(trim(line)) > 0)"""
    for d, chosen in ((",", "false"), (";", "true"), ("\t", "false"), ("|", "false"))).replace("'\t'", "chr(9)"))
register("read_delimited_customer", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
register("read_json_events", "SELECT event_id, user_id, event_type, value, props FROM events")
register("apply_contract_customer", f"""SELECT c_custkey, {CUST_NAME} AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  c_mktsegment, 0 AS n_cast_errors FROM customer""")


# --- whole jobs ----------------------------------------------------------------------------
register("synthesize_orders_offline", """SELECT 'ORDER_KEY-' || k AS order_key, CAST(length('ORDER_KEY-' || k) AS VARCHAR) AS key_len
FROM (SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS k)""")


def _synth_users() -> str:
    from .fixtures import customer_profile
    sql = gen_sql([c.to_dict() for c in customer_profile()], pk="customer_id")
    # the written csv carries the contract's types: integer -> bigint, date -> date, boolean
    return f"SELECT * EXCLUDE (row_idx) FROM ({sql})"


register("synthesize_users_rules", _synth_users())
register("dedup_within_batch_lineitem", f"""SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_linenumber, l_orderkey ORDER BY {LI_ORDER}) = 1""")


def _validate_generated_sql() -> str:
    from .fixtures import customer_profile
    rows = []
    for c in customer_profile():
        if not c.nullable:
            rows.append(("not_null", c.name))
        if c.type in _LOOKS_LIKE:
            rows.append(("type_format", c.name))
        if c.pattern:
            rows.append(("pattern", c.name))
    vals = ", ".join(f"('{a}', '{b}', CAST(0 AS BIGINT))" for a, b in rows)
    n = "(SELECT count(*) FROM customer)"
    return (f"SELECT * FROM (VALUES {vals}) t(check_name, column_name, violations) "
            f"UNION ALL SELECT 'row_count', NULL, CAST(abs({n} - {n}) AS BIGINT) "
            f"UNION ALL SELECT 'column_set', NULL, CAST(0 AS BIGINT)")


register("validate_generated_users", _validate_generated_sql())


def _prompt_json_sql() -> str:
    from .plans.prompts import JSON_PROMPT_RULES
    cols = ["event_id", "user_id", "event_type", "value", "props"]
    obj = " || ',\n' || ".join(f"'    \"{c}\": ' || to_json(CAST({c} AS VARCHAR))" for c in cols)
    samples = (f"(SELECT '[\n' || string_agg('  {{\n' || {obj} || '\n  }}', ',\n' ORDER BY event_id) || '\n]' "
               "FROM (SELECT * FROM events ORDER BY event_id LIMIT 3))")
    head = "'Generate ' || CAST(target_rows AS VARCHAR) || ' rows of realistic tabular data.\nDataset Name: events\n'"
    body = f"{head} || '\nSample Rows:\n' || {samples} || '\n' || {_sql_lit(JSON_PROMPT_RULES)}"
    p = plan(["events"]).replace(f"{len(COLUMNS['events'])} AS num_columns", "0 AS num_columns")
    return f"""SELECT batch_num, CAST(length(p) AS INTEGER) AS prompt_length, md5(p) AS prompt_md5
FROM (SELECT batch_num, {body} AS p FROM ({p}))"""


register("prompt_json_events", _prompt_json_sql())
register("roundtrip_lineitem_replies", "SELECT *, 0 AS n_cast_errors FROM lineitem")
def _mimic_numeric_sql(column: str, value: str, back: str) -> str:
    """Inverse of 101 exact quantiles of ``value`` at a draw per key of orders."""
    return f"""WITH v AS (SELECT {value} AS v FROM orders WHERE {column} IS NOT NULL AND NOT isnan({value})),
r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rk FROM v),
p AS (SELECT i, i / 100 * ((SELECT count(*) FROM v) - 1) AS pos FROM range(0, 101) t(i)),
g AS (SELECT p.i, lo.v + (hi.v - lo.v) * (p.pos - floor(p.pos)) AS q
      FROM p JOIN r lo ON lo.rk = floor(p.pos)
             JOIN r hi ON hi.rk = least(ceil(p.pos), (SELECT count(*) FROM v) - 1)),
s AS (SELECT i AS row_idx, CAST({_chunk(_h(column, 'q'))} AS DOUBLE) / CAST(4294967296 AS DOUBLE) * 100 AS u
      FROM {KEYED_FROM['orders']})
SELECT s.row_idx, {back.format(q='(glo.q + (ghi.q - glo.q) * (s.u - floor(s.u)))')} AS {column}
FROM s JOIN g glo ON glo.i = CAST(floor(s.u) AS BIGINT) JOIN g ghi ON ghi.i = least(CAST(floor(s.u) AS BIGINT) + 1, 100)"""


register("mimic_price", _mimic_numeric_sql("o_totalprice", "CAST(o_totalprice AS DOUBLE)", "{q}"))
register("mimic_orderdate", _mimic_numeric_sql("o_orderdate", "CAST(epoch_us(o_orderdate) AS DOUBLE)",
                                               "make_timestamp(CAST(floor{q} AS BIGINT))"))


def _report_documents_sql() -> str:
    from .fixtures import REPORT_CONTRACT_DOCUMENTS
    saved = VALIDATE_CONTRACTS.get("documents")
    VALIDATE_CONTRACTS["documents"] = REPORT_CONTRACT_DOCUMENTS
    try:
        cols = validate_sql("documents")
    finally:
        if saved is None:
            VALIDATE_CONTRACTS.pop("documents")
    names = [c["name"] for c in REPORT_CONTRACT_DOCUMENTS]
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM documents" for c in names)
    low = f"""SELECT 'low_variety' AS check_name, column_name,
  CAST(CASE WHEN cnt / total > 0.5 THEN cnt ELSE 0 END AS BIGINT) AS violations
FROM (SELECT column_name, cnt, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn,
        sum(cnt) OVER (PARTITION BY column_name) AS total
      FROM (SELECT column_name, value, count(*) AS cnt FROM ({long}) WHERE value IS NOT NULL GROUP BY ALL))
WHERE rn = 1"""
    place = f"SELECT 'placeholder', 'text', CAST(sum(rows) AS BIGINT) FROM ({_placeholder_sql()})"
    copies = ("SELECT 'sample_copies', NULL, count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM "
              "(SELECT * FROM documents ORDER BY doc_id LIMIT 5) s WHERE "
              + " AND ".join(f"s.{c} IS NOT DISTINCT FROM d.{c}" for c in names) + ")")
    gaps = f"SELECT 'key_gaps', 'doc_id', count(*) FROM ({_gaps('SELECT doc_id AS k FROM documents')})"
    kq = key_quality("documents", "doc_id")
    return f"""{cols}
UNION ALL SELECT 'row_count', NULL, CAST(0 AS BIGINT)
UNION ALL SELECT 'column_set', NULL, CAST(0 AS BIGINT)
UNION ALL SELECT 'key_duplicates', 'doc_id', duplicates_found FROM ({kq})
UNION ALL SELECT 'key_missing', 'doc_id', nulls_found FROM ({kq})
UNION ALL {gaps}
UNION ALL SELECT 'duplicate_rows', NULL, CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM
  (SELECT count(*) AS c FROM documents GROUP BY lang, source, text HAVING count(*) > 1)
UNION ALL {copies}
UNION ALL {low}
UNION ALL {place}"""


register("validation_report_documents", _report_documents_sql())
register("stream_shortfall_customer", """SELECT p.batch_num, p.target_rows, CAST(coalesce(k.kept, 0) AS BIGINT) AS kept_rows,
  p.target_rows - coalesce(k.kept, 0) AS shortfall
FROM (SELECT batch_num, target_rows FROM (""" + plan(["customer"]).replace("5 AS num_columns", "4 AS num_columns") + """)) p
LEFT JOIN (SELECT c_custkey // 30 + 1 AS batch_num, count(*) FILTER (WHERE c_custkey % 17 <> 0) AS kept
           FROM customer GROUP BY 1) k ON p.batch_num = k.batch_num""")
register("mimic_rows_part", f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part),
g AS (SELECT i AS row_idx, {_wide(_h('__row', 'k'))} % (SELECT count(*) FROM part) AS k,
             (CAST({_chunk(_h('p_retailprice', 'j'))} AS DOUBLE) / CAST(4294967296 AS DOUBLE)) * 2 - 1 AS d
      FROM {KEYED_FROM['part']})
SELECT g.row_idx, s.p_partkey, s.p_name, s.p_brand, s.p_type, s.p_size,
       s.p_retailprice * (1 + CAST(0.1 AS DOUBLE) * g.d) AS p_retailprice
FROM g JOIN s ON g.k = s.k""")
register("unique_rows_documents", "SELECT lang, source, md5(text) AS text_md5 FROM (SELECT DISTINCT lang, source, text FROM documents)")


# --- added with the split readers, redraws and distinct rows --------------------------------
_LONG = "'\"' || repeat(c_name || ',\"\"|\"\"', 300) || '\"'"
register("delimiter_counts_long_quotes", " UNION ALL ".join(
    f"""SELECT {d} AS delimiter, min(n) AS min_count, max(n) AS max_count, count(*) AS total_lines,
  (min(n) = max(n) AND min(n) > 0) AS consistent, {chosen} AS chosen
FROM (SELECT CAST(length(line) - length(replace(line, {d}, '')) AS INTEGER) AS n
      FROM (SELECT regexp_replace(concat_ws(';', CAST(c_custkey AS VARCHAR), {_LONG}, c_mktsegment), '"[^"]*"', '', 'g') AS line
            FROM customer))"""
    for d, chosen in (("','", "false"), ("';'", "true"), ("chr(9)", "false"), ("'|'", "false"))))
register("read_multiline_customer", """SELECT c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || 'second, "quoted"' || chr(10) || chr(10) || 'line'
       WHEN c_custkey % 7 = 0 THEN repeat(c_name || chr(10), 40) ELSE c_name END AS c_name,
  CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
register("infer_json_contract_events", """SELECT * FROM (VALUES (0, 'event_id', 'integer'), (1, 'user_id', 'integer'),
  (2, 'event_type', 'string'), (3, 'value', 'float'), (4, 'props', 'string')) t(ordinal, column_name, semantic_type),
  (SELECT false AS nullable, count(*) AS total_rows FROM events)""")
register("profile_json_roundtrip", """SELECT c.*, (SELECT count(*) FROM events) AS total_rows FROM (
  SELECT 'event_id' AS column_name, 'bigint' AS physical_type, 'uuid' AS semantic_type, bool_or(event_id IS NULL) AS nullable FROM events
  UNION ALL SELECT 'user_id', 'bigint', 'uuid', bool_or(user_id IS NULL) FROM events
  UNION ALL SELECT 'event_type', 'string', 'string', bool_or(event_type IS NULL) FROM events
  UNION ALL SELECT 'value', 'double', 'float', bool_or(value IS NULL) FROM events
  UNION ALL SELECT 'props', 'string', 'string', bool_or(props IS NULL) FROM events) c""")


def _mimic_price_nullable_sql() -> str:
    full = _mimic_numeric_sql("o_totalprice", "CAST(o_totalprice AS DOUBLE)", "{q}").replace("FROM orders WHERE", "FROM src WHERE")
    i = _wide(_h("o_totalprice", "n"))
    return f"""WITH src AS (SELECT CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders),
made AS ({full})
SELECT row_idx, CASE WHEN {i.replace("CAST(i AS", "CAST(row_idx AS")} % (SELECT count(*) FROM src)
  >= (SELECT count(*) FROM src WHERE o_totalprice IS NULL) THEN o_totalprice END AS o_totalprice FROM made"""


register("mimic_price_nullable", _mimic_price_nullable_sql())


def _novel_sql() -> str:
    """Per customer the first draw (seeds a step apart) that is no sample."""
    from .fixtures import NOVEL_CONTRACT
    from .operators.generate import REDRAW_STEP
    salted = f"CAST({SEED} + k * {REDRAW_STEP} AS VARCHAR)"
    flag, level = (_gen_value(c).replace(f"'{SEED}'", salted) for c in NOVEL_CONTRACT)
    return f"""WITH s AS (SELECT DISTINCT p_partkey % 2 = 0 AS flag, CAST(1 + p_partkey % 3 AS BIGINT) AS level
  FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10)),
d AS (SELECT i, k, {flag} AS flag, {level} AS level FROM {KEYED_FROM['customer']}, range(0, 64) t(k))
SELECT i AS row_idx, flag, level FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.flag = d.flag AND s.level = d.level)
QUALIFY row_number() OVER (PARTITION BY i ORDER BY k) = 1"""


register("novel_rows_redrawn", _novel_sql())


def _unique_sql() -> str:
    """Rounds of the keyed permutation, then the digits of each half."""
    from .fixtures import UNIQUE_CONTRACT
    from .operators.generate import FEISTEL_ROUNDS, halves
    from .spec import ColumnContract
    first, second, _ = halves([ColumnContract.from_dict(c) for c in UNIQUE_CONTRACT])
    sizes = []
    for side in (first, second):
        size = 1
        for _, n in side:
            size *= n
        sizes.append(size)
    a, b = sizes
    sql = f"SELECT i, (i - 1) // {b} AS x, (i - 1) % {b} AS y FROM (SELECT p_partkey + 1 AS i FROM part)"
    for k in range(FEISTEL_ROUNDS):
        of, to, size = ("y", "x", a) if k % 2 == 0 else ("x", "y", b)
        h = f"md5(concat_ws('|', '{SEED}', '__unique', CAST({of} AS VARCHAR), 'f{k}'))"
        sql = f"SELECT i, ({to} + {_wide(h)} % {size}) % {size} AS {to}, {of} FROM ({sql})"
    at = {}
    for side, name in ((first, "x"), (second, "y")):
        stride = 1
        for c, n in side:
            at[c.name] = f"(({name} // {stride}) % {n})"
            stride *= n
    label = _gen_value(UNIQUE_CONTRACT[2])
    return f"""SELECT i AS row_idx, CAST(1 + {at['units']} AS BIGINT) AS units, {at['flag']} = 0 AS flag, {label} AS label,
  DATE '2024-01-01' + CAST({at['day']} AS INTEGER) AS day, CAST({at['price']} / 100 AS DOUBLE) AS price FROM ({sql})"""


register("gen_unique_rows", _unique_sql())
