"""Queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from marlstone.llm.collocations import ORACLE as PHRASE_SQL
from marlstone.llm.collocations import op13_phrase_collocations
from marlstone.llm.common import table
from marlstone.llm.jaccard import op10_ngram_jaccard_join
from marlstone.llm.language import op6_language_id
from marlstone.llm.licenses import op5_license_scans
from marlstone.llm.licenses import sql as license_sql
from marlstone.llm.line_dedup import ORACLE as LINE_SQL
from marlstone.llm.line_dedup import op11_line_dedup
from marlstone.llm.media import op7_media_copies
from marlstone.llm.mixing import op4_mix_sources
from marlstone.llm.packing import op9_best_fit_packing
from marlstone.llm.pages import op2_html_extraction
from marlstone.llm.quality_classifier import op8_quality_classifier
from marlstone.llm.quality_rules import op3_quality_rules
from marlstone.llm.secrets import op1_secret_scans
from marlstone.llm.whitening import op12_embedding_whitening

__all__ = ["ORACLE", "QUERIES", "table"]


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (
    op1_secret_scans, op2_html_extraction, op3_quality_rules, op4_mix_sources, op5_license_scans, op6_language_id, op7_media_copies,
    op8_quality_classifier, op9_best_fit_packing, op10_ngram_jaccard_join, op11_line_dedup, op12_embedding_whitening, op13_phrase_collocations,
)
QUERIES = {**{f.__name__: f for f in OPERATORS}, "pipeline": pipeline}
ORACLE: dict[str, str] = {"op5_license_scans": license_sql(), "op11_line_dedup": LINE_SQL, "op13_phrase_collocations": PHRASE_SQL}
