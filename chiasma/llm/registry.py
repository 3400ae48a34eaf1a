"""The queries of this subpackage and the SQL of those that SQL can express."""

from chiasma.llm import centroids, decontaminate, line_dedup, media, mixing, quality_rules, sharding, simhash, token_counts, token_output, toxicity, url_filter, whitening

MODULES = [url_filter, token_output, line_dedup, token_counts, decontaminate, sharding, simhash, media, toxicity, mixing, quality_rules, whitening, centroids]


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
