"""Queries of the training-data operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op3_decontaminate
from .language import op5_language
from .lm import op6_lm_score
from .mixing import op8_mixing
from .neighbours import op9_neighbours
from .pii import op2_pii
from .quality import op7_quality
from .simhash import op4_simhash
from .spans import op1_spans
from .trie import OP11_SQL, op11_prefix_trie
from .urls import op10_urls
from .warc import OP12_SQL, op12_warc


def queries() -> dict:
    import corpus_pipeline

    ops = (op1_spans, op2_pii, op3_decontaminate, op4_simhash, op5_language, op6_lm_score, op7_quality, op8_mixing, op9_neighbours, op10_urls, op11_prefix_trie, op12_warc, op13_collocations)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Trained models and graph components are beyond SQL, and some others are too slow there on whole tables; tests/llm has
    brute-force versions on small tables instead."""
    return {"op11_prefix_trie": OP11_SQL, "op12_warc": OP12_SQL, "op13_collocations": OP13_SQL}
