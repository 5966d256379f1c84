"""The dealt operators as queries over the given tables, with their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import (
    decontaminate,
    filter_audit,
    fingerprints,
    html_extract,
    kneser_ney,
    language_id,
    lexical_search,
    line_dedup,
    mixing,
    ngram_join,
    token_counts,
    toxicity,
    training_order,
)
from strandweave.llm.common import fold_of, load

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Target weights of the labelled domains: factors on the corpus's own token shares.
MIX_TARGETS = {"good": 1.0, "low": 0.5, "toxic": 0.5}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = mixing.label_domains(load(spark, sf_dir, "labels"))
    rated, model, _ = mixing.rates(docs, labels, MIX_TARGETS, relative=True)
    return rated.select(
        "doc_id", F.col("tokens").alias("n_tokens"),
        *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", "copies")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(load(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _, _ = training_order.materialise(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return index


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(fold_of("doc_id", 10) != 0))
    return kneser_ney.score(docs, model).select(
        "doc_id", (fold_of("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return fingerprints.compared(docs, fingerprints.rarity_ranks(docs))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold_of("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold_of("doc_id", 4) != 2))
    return language_id.predict(docs, model).select(
        "doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer_path())


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_source_mixing": op2_source_mixing,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_training_order": op4_training_order,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_document_fingerprints": op6_document_fingerprints,
        "op7_toxicity": op7_toxicity,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_language_id": op9_language_id,
        "op10_token_counts": op10_token_counts,
        "op11_ranked_lexical_search": op11_ranked_lexical_search,
        "op12_filter_interaction_audit": op12_filter_interaction_audit,
        "op13_html_extraction": op13_html_extraction,
    }


def _sql_words(text: str) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    lower = f"translate(coalesce({text}, ''), '{letters.upper()}', '{letters}')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: Every window of every item looked for at every place of every document.
OP8_SQL = f"""
    WITH low AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
    item AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_sql_words('text')} AS w FROM benchmark)),
    win AS (SELECT DISTINCT item_id, w[i:i + n - 1] AS k FROM (
        SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item WHERE n > 0)),
    spot AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
        FROM low, (SELECT DISTINCT len(k) AS n FROM win) WHERE len(w) >= n),
    hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS k FROM spot) JOIN win USING (k)),
    cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
        SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM low LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: All pairs of documents that share a shingle, and reachability over their links.
OP3_SQL = f"""
    WITH RECURSIVE low AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
    shingle AS (SELECT DISTINCT doc_id, w[i:i + n - 1] AS k FROM (
        SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM low WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.k = b.k AND a.doc_id <> b.doc_id
        GROUP BY ALL),
    link AS MATERIALIZED (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
        WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
    reach AS (SELECT a AS d, a AS r FROM link UNION SELECT d, b FROM reach JOIN link ON a = r)
    SELECT low.doc_id, coalesce(class_id, low.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n, 0)::BIGINT AS n_shingles
    FROM low LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) USING (doc_id)
    LEFT JOIN (SELECT d AS doc_id, min(r) AS class_id FROM reach GROUP BY d) USING (doc_id)"""


#: The exact score of every document that shares a term with an item.
OP11_SQL = f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
    total AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM doc WHERE len(w) > 0),
    item AS (SELECT item_id, t, count(*) AS reps FROM (SELECT item_id, unnest({_sql_words('text')}) AS t FROM benchmark) GROUP BY ALL),
    tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM doc) WHERE t IN (SELECT t FROM item) GROUP BY ALL),
    weight AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), total),
    m AS (SELECT r, doc_id, 25 + (75 * len(w)::BIGINT * nd) // nt AS m FROM doc, total WHERE len(w) > 0),
    scored AS (SELECT item_id, r, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM item JOIN tf USING (t) JOIN weight USING (t) JOIN m USING (r) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

#: Every document, order and step told by the letters that the document fails.
OP12_SQL = """
    WITH letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    ord AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
        WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    txt AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    lab AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
    doc AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
        FROM txt LEFT JOIN lab USING (doc_id)),
    cell AS (SELECT part, good, toxic, fails, count(*) AS n FROM doc GROUP BY ALL),
    gone AS (SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, fails,
        contains(fails, filter_order[step]) AS f,
        len(list_filter(range(1, step), lambda k: contains(fails, filter_order[k]))) = 0 AS open
        FROM cell, ord, (SELECT unnest(range(1, 6)) AS step)),
    figure AS (SELECT part, filter_order, step, filter,
        coalesce(sum(n) FILTER (open AND NOT f), 0) AS kept, coalesce(sum(n) FILTER (open AND f), 0) AS removed,
        coalesce(sum(n) FILTER (f AND NOT open), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
        coalesce(sum(n) FILTER (open AND f AND good), 0) AS good_lost, coalesce(sum(n) FILTER (open AND f AND toxic), 0) AS toxic_lost
        FROM gone GROUP BY ALL)
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
        unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
        (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter
    FROM figure"""


def llm_statements() -> dict[str, str]:
    """Statements of the queries that SQL can express; models, permutations and tokenizers are tested otherwise."""
    return {"op3_ngram_jaccard_join": OP3_SQL, "op8_benchmark_decontamination": OP8_SQL,
            "op11_ranked_lexical_search": OP11_SQL, "op12_filter_interaction_audit": OP12_SQL}
