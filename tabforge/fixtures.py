"""Layout of the driver tables and the contracts the registered queries use."""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Column names per table (the driver tables' layout), used to spell per-column SQL.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
DOUBLE_COLUMNS = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "value"}

GEN_CONTRACTS = {
    "gen_integer": [{"name": "age", "type": "integer", "pattern": "18-65"}],
    "gen_date": [{"name": "signup_date", "type": "date", "pattern": "2020-01-01 to 2025-12-31"}],
    "gen_datetime": [{"name": "seen_at", "type": "datetime", "pattern": "2024-01-01 to 2024-01-31"}],
    "gen_boolean": [{"name": "is_active", "type": "boolean"}],
    "gen_normal": [{"name": "score", "type": "float", "pattern": "0-100", "distribution": "normal"}],
    "gen_skewed": [{"name": "score", "type": "float", "pattern": "0-100", "distribution": "skewed"}],
    "gen_random": [{"name": "score", "type": "float", "pattern": "0-100", "distribution": "random"}],
    "gen_float_narrow": [{"name": "ratio", "type": "float", "pattern": "0.001-0.009"}],
    "gen_uuid": [{"name": "token", "type": "uuid"}],
    "gen_regex": [{"name": "code", "type": "string", "pattern": "[A-Z]{3}-[0-9]{4}"}],
    "gen_text_types": [{"name": "full_name", "type": "name"}, {"name": "email", "type": "email"},
                       {"name": "phone", "type": "phone", "nullable": True},
                       {"name": "home", "type": "address"}, {"name": "site", "type": "url"},
                       {"name": "city", "type": "string", "nullable": True}],
}

# Distinct rows by construction: 50 * 2 * 91 * 1,000,000 combinations, and a free text.
UNIQUE_CONTRACT = [
    {"name": "units", "type": "integer", "pattern": "1-50"}, {"name": "flag", "type": "boolean"},
    {"name": "label", "type": "string"}, {"name": "day", "type": "date", "pattern": "2024-01-01 to 2024-03-31"},
    {"name": "price", "type": "float", "pattern": "0.00-9999.99"},
]
# Ten combinations, some of which are samples.
NOVEL_CONTRACT = [{"name": "flag", "type": "boolean"}, {"name": "level", "type": "integer", "pattern": "1-5"}]

# A generated companion of the customer table: eight columns of eight types.
CUSTOMER_PROFILE = [
    {"name": "customer_id", "type": "uuid"}, {"name": "c_name", "type": "name"},
    {"name": "contact", "type": "email"}, {"name": "c_nationkey", "type": "integer", "pattern": "0-24"},
    {"name": "c_mktsegment", "type": "string", "nullable": True}, {"name": "c_phone", "type": "phone", "nullable": True},
    {"name": "first_order", "type": "date", "pattern": "1992-01-01 to 1998-12-31"},
    {"name": "in_credit", "type": "boolean"},
]

# Contracts the validation queries check the driver tables against.
VALIDATE_CONTRACTS = {
    "customer": [{"name": "c_custkey", "type": "integer"}, {"name": "c_name", "type": "name"},
                 {"name": "c_nationkey", "type": "integer", "pattern": "0-20"},
                 {"name": "c_acctbal", "type": "float", "pattern": "0-5000"},
                 {"name": "c_mktsegment", "type": "string", "nullable": True, "pattern": "[A-Z]+"}],
    "pages": [{"name": "page_id", "type": "integer"}, {"name": "url", "type": "url"},
              {"name": "html", "type": "string"}],
    "lineitem": [{"name": "l_quantity", "type": "float", "pattern": "1-50"},
                 {"name": "l_discount", "type": "float", "pattern": "0-0.1"},
                 {"name": "l_tax", "type": "float", "pattern": "0-0.08"},
                 {"name": "l_returnflag", "type": "string", "pattern": "[ANR]"},
                 {"name": "l_linestatus", "type": "string", "pattern": "[OF]"},
                 {"name": "l_shipdate", "type": "datetime", "pattern": "1992-01-01 to 1998-12-31"}],
}

# Contract for the combined validation report over documents.
REPORT_CONTRACT_DOCUMENTS = [
    {"name": "doc_id", "type": "integer"}, {"name": "text", "type": "string"},
    {"name": "lang", "type": "string", "pattern": "[a-z]{2}"}, {"name": "source", "type": "string"},
    {"name": "n_chars", "type": "integer", "pattern": "1-200000"}]


def customer_profile():
    """CUSTOMER_PROFILE as column contracts."""
    from .spec import ColumnContract
    return [ColumnContract.from_dict(d) for d in CUSTOMER_PROFILE]
