"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

from heristat.llm.common import table

#: name: (module, its function, tables)
_QUERIES = {
    "op1_webp_media": ("media", "query", ("documents",)),
    "op2_temporal_url_filter": ("urlfilter", "query", ("pages",)),
    "op3_simhash_bktree": ("simhash", "query", ("documents",)),
    "op4_warc_zip": ("warczip", "query", ("pages",)),
    "op5_suffix_array": ("suffix", "query", ("documents",)),
    "op6_mixing": ("mixing", "query", ("documents",)),
    "op7_cross_polytope": ("ann", "query", ("embeddings",)),
    "op8_toxicity": ("toxicity", "query", ("documents", "labels")),
    "op9_secrets": ("secrets", "query", ("documents",)),
    "op10_packing": ("packing", "query", ("documents",)),
}


def _query(module: str, function: str, tables: tuple[str, ...]):
    def run(spark, sf_dir):
        return getattr(import_module(f"heristat.llm.{module}"), function)(*(table(spark, sf_dir, t) for t in tables))

    return run


def queries() -> dict:
    return {name: _query(*x) for name, x in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from heristat.llm import mixing, urlfilter, warczip

    return {"op2_temporal_url_filter": urlfilter.SQL, "op4_warc_zip": warczip.SQL, "op6_mixing": mixing.SQL}
