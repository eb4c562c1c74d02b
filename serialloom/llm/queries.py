"""The registered queries of the operators, each with its SQL where SQL can express it."""

from . import chat_format, decontamination, divergence, exact_dedup, language_id, lm_scoring, main_text, ngram_join, packing, quality, spelling, toxicity, url_filter

QUERIES = {
    **ngram_join.QUERIES,
    **lm_scoring.QUERIES,
    **toxicity.QUERIES,
    **exact_dedup.QUERIES,
    **packing.QUERIES,
    **main_text.QUERIES,
    **decontamination.QUERIES,
    **chat_format.QUERIES,
    **url_filter.QUERIES,
    **language_id.QUERIES,
    **spelling.QUERIES,
    **divergence.QUERIES,
    **quality.QUERIES,
}
