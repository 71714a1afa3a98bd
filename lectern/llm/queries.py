"""The queries of this subpackage, each an operator with production parameters on its whole table, and their SQL."""

from __future__ import annotations

from lectern.llm.decontaminate import contaminated
from lectern.llm.embeddings import dedup_embeddings, dedup_embeddings_sql
from lectern.llm.jaccard import similar_components_query, similar_components_sql
from lectern.llm.langid import identify_query
from lectern.llm.mixing import mix_sources, mix_sources_sql
from lectern.llm.negatives import mine_negatives_query, mine_negatives_sql
from lectern.llm.perplexity import quality_query
from lectern.llm.pii import pseudonymise_query
from lectern.llm.recurrent import log_likelihood
from lectern.llm.resampling import resample, resample_sql
from lectern.llm.shared import prepare, table
from lectern.llm.toxicity import toxicity_query
from lectern.llm.url_filter import judge_urls, judge_urls_sql
from lectern.llm.warc import archive_pages_query, archive_pages_sql


def on(name: str, operator):
    """The query that applies `operator` to the table `name`."""

    def run(spark, folder):
        prepare(spark)
        return operator(table(spark, folder, name))

    return run


def decontamination(spark, folder):
    prepare(spark)
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def good_texts(spark, folder):
    prepare(spark)
    return quality_query(table(spark, folder, "documents"), table(spark, folder, "labels"))


def toxic_texts(spark, folder):
    prepare(spark)
    return toxicity_query(table(spark, folder, "documents"), table(spark, folder, "labels"))


def resampled(spark, folder):
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    "op1_pii_pseudonyms": on("documents", pseudonymise_query),
    "op6_arc_to_warc": on("pages", archive_pages_query),
    "op2_quality_perplexity": good_texts,
    "op3_toxicity": toxic_texts,
    "op4_language_id": on("documents", identify_query),
    "op5_embedding_dedup": on("embeddings", dedup_embeddings),
    "op7_decontamination": decontamination,
    "op8_mixing": on("documents", mix_sources),
    "op9_jaccard_join": on("documents", similar_components_query),
    "op10_url_filter": on("pages", judge_urls),
    "op11_recurrent_scores": on("documents", log_likelihood),
    "op12_importance_resampling": resampled,
    "op13_hard_negatives": on("embeddings", mine_negatives_query),
}

ORACLES = {
    "op5_embedding_dedup": dedup_embeddings_sql(),
    "op6_arc_to_warc": archive_pages_sql(),
    "op8_mixing": mix_sources_sql(),
    "op9_jaccard_join": similar_components_sql(),
    "op10_url_filter": judge_urls_sql(),
    "op12_importance_resampling": resample_sql(),
    "op13_hard_negatives": mine_negatives_sql(),
}
