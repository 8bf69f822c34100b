"""The queries of this subpackage and their SQL."""

from wireflow.llm import automata_dedup, bwt_dedup, conversations, exact_dedup, host_rules, mixing, near_dedup, packing, pii, sharding, spelling, toxicity, url_filter

MODULES = (url_filter, exact_dedup, host_rules, sharding, mixing, packing, pii, automata_dedup, bwt_dedup, near_dedup, spelling, toxicity, conversations)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
