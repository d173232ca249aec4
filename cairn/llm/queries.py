"""Queries of the training-text problems (pN_...) and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import markup, mixture, neardup, neighbours, packing, rankfuse, subjects, terms, tokens, vocabulary
from cairn.operators import ann
from cairn.session import materialize, tidy
from cairn.sources.tables import table

SCORES = ["score", "bm25_score", "embed_score"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return terms.records(table(spark, d, "documents_idx"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The most distinctive shared term of each record asked about."""
    probes = table(spark, d, "probes").where("purpose = 'keyword' AND target_id IS NOT NULL").select("probe_id", F.col("target_id").alias("doc_id"))
    weights = terms.term_weights(table(spark, d, "postings"), _records(spark, d), only=probes)
    return probes.join(terms.keywords(weights), "doc_id").select("probe_id", "token")


def p1_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The five terms of highest weight of every record."""
    top = terms.top_terms(terms.term_weights(table(spark, d, "postings"), _records(spark, d)))
    return top.select("doc_id", F.col("place").cast("bigint").alias("place"), "token", F.round("weight", 6).alias("weight"))


def _median_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rankfuse.median_rank(table(spark, d, "search_result"), SCORES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The item that belongs first in each query."""
    return rankfuse.first_items(_median_ranks(spark, d))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole fused ranking of each query."""
    out = rankfuse.fused(_median_ranks(spark, d))
    return out.select("query_id", "doc_id", "place", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Useless terms under each configuration: rare, common or cut."""
    vocab, n = vocabulary.vocabulary(table(spark, d, "postings"), _records(spark, d))
    return vocabulary.marks(vocab, n, table(spark, d, "embed_config"))


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Uses and records of every term."""
    return vocabulary.vocabulary(table(spark, d, "postings"), _records(spark, d))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with markup, and their headings, list items, code blocks and formulas in reading order."""
    docs = table(spark, d, "documents_idx").select("doc_id", "path", "content")
    return markup.structure(markup.extract(docs)).withColumnRenamed("id", "doc_id")


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every record."""
    docs = table(spark, d, "documents_idx").select("doc_id", "path", "content")
    return markup.clean_text(markup.extract(docs)).withColumnRenamed("id", "doc_id")


def p5_votes(spark: SparkSession, d: str) -> DataFrame:
    """The vote on container paths of each host."""
    return markup.votes(markup.pages(table(spark, d, "documents_idx").select("doc_id", "path", "content")))


#: Markup that should be gone from clean text.
SIGNS = {
    "tag": r"(?i)</?(?:p|div|span|b|i|em|strong|ul|ol|li|h[1-6]|br|table|tr|td|center|font)(?:\s[^<>]*)?/?>",
    "wiki": r"\[\[|\]\]|\{\{|\}\}|'''",
    "latex": r"\\(?:textbf|textit|emph|section|begin|end|item|cite|ref)\b",
    "link": r"\]\(",
    "comment": r"<!--|-->",
    "entity": r"&(?:nbsp|amp|lt|gt|quot);",
}


def p5_residue(spark: SparkSession, d: str) -> DataFrame:
    """Records with each kind of markup before cleaning, and whether fewer than one in two hundred has it still."""
    docs = table(spark, d, "documents_idx").select("doc_id", "path", "content")
    one = docs.where("doc_id IS NOT NULL AND content IS NOT NULL").groupBy("doc_id").agg(F.min("content").alias("c"))
    before = one.agg(*(F.count_if(F.col("c").rlike(p)).alias(n) for n, p in SIGNS.items()))
    before = before.select(F.inline(F.array(*(F.struct(F.lit(n).alias("sign"), F.col(n).alias("before")) for n in SIGNS))))
    left = markup.residue(markup.extract(docs), SIGNS)
    return before.join(left, "sign").select("sign", "before", (F.col("left") * 200 <= F.col("records")).alias("gone"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose sets of three consecutive words have a similarity of at least 0.6."""
    docs = table(spark, d, "documents_idx").select("doc_id", "content")
    pairs = neardup.all_pairs(*neardup.near_duplicates(docs, "doc_id", "content", words=3, threshold=0.6))
    return pairs.toDF("doc_id_a", "doc_id_b")


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Each text of documents with its class of copies and the number of near-duplicate classes (five words, 0.8)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return neardup.link_counts(*neardup.near_duplicates(docs, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each text of documents with its group: the texts that near-duplicate links connect (five words, 0.8)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return neardup.groups(*neardup.near_duplicates(docs, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other vectors of each item asked about, in its own table."""
    found = []
    for purpose, name, key, vec in (("doc_neighbours", "doc_vec", "doc_id", "q"), ("token_neighbours", "token_vec", "token", "vec")):
        index = neighbours.VectorIndex(table(spark, d, name), key, vec)
        probes = table(spark, d, "probes").where((F.col("purpose") == purpose) & F.col("target_id").isNotNull()).select("probe_id", F.col("target_id").alias("id"))
        targets = index.vectors.join(probes.select("id").distinct(), "id", "left_semi")
        found.append(probes.join(index.search(targets), "id").select("probe_id", "neighbour"))
    return found[0].unionByName(found[1])


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other vectors of every document and token vector, in its own table (``vectors``)."""
    near = []
    for name, key, vec in (("doc_vec", "doc_id", "q"), ("token_vec", "token", "vec")):
        of_all = neighbours.VectorIndex(table(spark, d, name), key, vec).neighbours_of_all()
        near.append(of_all.select(F.lit(name).alias("vectors"), "id", "neighbour", F.round("similarity", 6).alias("similarity")))
    return near[0].unionByName(near[1])


def p7_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether at least nine tenths of the exact neighbours are found, for every token vector and for the document vectors whose
    id ends in 0; the exact ones come from all vectors, in blocks."""
    out = None
    for name, key, vec in (("doc_vec", "doc_id", "q"), ("token_vec", "token", "vec")):
        index = neighbours.VectorIndex(table(spark, d, name), key, vec)
        asked = index.vectors.where(F.col("id").endswith("0")) if name == "doc_vec" else index.vectors
        found = materialize(index.search(asked).select(F.col("id").alias("query_id"), F.col("neighbour").alias("doc_id")), "found")
        # the vector itself is the nearest of all, so one more is asked for
        rows = index.vectors.select(F.col("id").alias("doc_id"), F.col("vec").alias("q"))
        exact = ann.exact(rows, rows.join(asked.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id"), 6)
        wanted = exact.where("query_id <> doc_id").withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where("rn <= 5")
        one = ann.recall(found, wanted).agg(F.count("*").alias("asked"), F.avg("recall").alias("recall"))
        one = one.select(F.lit(name).alias("vectors"), "asked", (F.col("recall") >= 0.9).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


def _capacities(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    """The parameter table of container sizes."""
    rows = table(spark, d, "pack_capacity").where("pack_id IS NOT NULL AND capacity_tokens > 0").distinct().orderBy("pack_id", "capacity_tokens").collect()
    return [(r["pack_id"], r["capacity_tokens"]) for r in rows]


def _packs(spark: SparkSession, d: str) -> DataFrame:
    """One packing for each capacity of the table, and one for all capacities jointly (``pack_id`` null)."""
    sized = packing.sized(table(spark, d, "documents"))
    each = _capacities(spark, d)
    out = packing.pack(sized, [c for _, c in each]).withColumn("pack_id", F.lit(None).cast("bigint"))
    for pack_id, capacity in each:
        out = out.unionByName(packing.pack(sized, [capacity]).withColumn("pack_id", F.lit(pack_id).cast("bigint")))
    return out


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text larger than the container, in its container: for each capacity alone, and with all
    capacities permitted side by side (``pack_id`` null), where the least-cost one is opened and each container downsized."""
    return _packs(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and part of their room filled, for each capacity and for all jointly."""
    return packing.report(_packs(spark, d), "pack_id")


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often each packing breaks a rule: a container of no permitted size, or fuller than its size, or filled otherwise than
    stated; a text that is cut without need, has gaps between its pieces or is missing. Never."""
    sized = packing.sized(table(spark, d, "documents"))
    return packing.broken(sized, materialize(_packs(spark, d), "packs"), _capacities(spark, d))


def p8_joint(spark: SparkSession, d: str) -> DataFrame:
    """All capacities permitted at once: every text in a container downsized to its contents."""
    return packing.pack(packing.sized(table(spark, d, "documents")), [c for _, c in _capacities(spark, d)])


def _sources(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"))
    return materialize(mixture.usable(sized), "sized")


def _mixed(sized: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Cut at the budget, then the room that a long text left at the end of a queue is filled, in two rounds."""
    return mixture.mixture(sized, table(spark, d, "mix_target"), fill=2)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each mixture in reading order."""
    return _mixed(_sources(spark, d), spark, d).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares of each source of each mixture, its budget and the source that sets it."""
    sized, mix = _sources(spark, d), table(spark, d, "mix_target")
    return mixture.reached(materialize(_mixed(sized, spark, d), "mixed"), mix, mixture.shares(sized, mix))


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often a mixture breaks a rule: texts used more than ``max_repeats`` times, a text used twice with one number, places
    that don't run from the first token to the last, sources that aren't wanted, more tokens than the budget, shares off by
    more than one text of the source. Never."""
    sized, mix = _sources(spark, d), table(spark, d, "mix_target")
    return mixture.broken(sized, mix, materialize(_mixed(sized, spark, d), "mixed"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    model = subjects.SubjectModel(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))
    return model.document_subjects()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of every document."""
    return _subjects(spark, d).select(F.col("id").alias("doc_id"), "subject")


def p10_functions(spark: SparkSession, d: str) -> DataFrame:
    """Each labelling function: on which part of the sentences it votes, and its learned accuracy."""
    model = subjects.SubjectModel(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))
    return model.functions().select("function", F.round("coverage", 4).alias("coverage"), F.round("accuracy", 4).alias("accuracy"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """What the corpus is about."""
    return subjects.composition(_subjects(spark, d))


_POSTINGS = """
WITH r AS (SELECT DISTINCT doc_id FROM documents_idx WHERE content IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT token, doc_id, max(tf)::BIGINT AS tf FROM postings WHERE token IS NOT NULL AND tf >= 1 AND doc_id IN (SELECT doc_id FROM r) GROUP BY ALL),
f AS (SELECT token, count(*) AS df, sum(tf)::BIGINT AS uses FROM p GROUP BY 1),
l AS (SELECT doc_id, sum(tf)::DOUBLE AS dl FROM p GROUP BY 1),
s AS (SELECT (SELECT count(*) FROM r)::DOUBLE AS n, avg(dl) AS avgdl FROM l),
w AS (SELECT p.doc_id, p.token, tf, df, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight
  FROM p JOIN f USING (token) JOIN l USING (doc_id), s)
"""
_RANKS = """
WITH u AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY scored_at DESC NULLS LAST) AS rn FROM search_result
  WHERE query_id IS NOT NULL AND doc_id IS NOT NULL),
v AS (SELECT query_id, doc_id, unnest([1, 2, 3]) AS s, unnest([score, bm25_score, embed_score]) AS v FROM u WHERE rn = 1),
k AS (SELECT query_id, s, count(*) AS n FROM v WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL HAVING count(DISTINCT v) > 1),
g AS (SELECT query_id, s, doc_id, rank() OVER (PARTITION BY query_id, s ORDER BY v DESC) AS place FROM v WHERE v IS NOT NULL AND NOT isnan(v)),
a AS (SELECT v.query_id, v.doc_id, coalesce(g.place, k.n + 1)::DOUBLE AS place FROM v JOIN k USING (query_id, s) LEFT JOIN g USING (query_id, s, doc_id)),
m AS (SELECT query_id, doc_id, median(place) AS median_rank, avg(place) AS mean_rank FROM a GROUP BY ALL),
o AS (SELECT query_id, doc_id, median_rank, mean_rank FROM (SELECT DISTINCT query_id, doc_id FROM v) LEFT JOIN m USING (query_id, doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank NULLS LAST, mean_rank NULLS LAST, doc_id) AS place FROM o)
"""
_WORDS = """
WITH RECURSIVE r AS (SELECT {id} AS id, min({text}) AS text FROM {table} WHERE {id} IS NOT NULL GROUP BY 1),
w AS (SELECT id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+'), lambda x: lower(x)) AS w FROM r),
s AS (SELECT DISTINCT id, sh FROM (SELECT id, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS sh FROM w WHERE len(w) >= {k})),
n AS (SELECT id, count(*) AS n, md5(string_agg(sh, '|' ORDER BY sh)) AS h FROM s GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY ALL),
j AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= {t})
"""

QUERIES = {"p1_found": p1_found, "p1_top_terms": p1_top_terms, "p2_found": p2_found, "p2_ranking": p2_ranking, "p4_found": p4_found, "p4_frequencies": p4_frequencies, "p5_found": p5_found, "p5_text": p5_text, "p5_votes": p5_votes, "p5_residue": p5_residue,
    "p6_found": p6_found, "p6_links": p6_links, "p6_groups": p6_groups,
    "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p7_recall": p7_recall, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_joint": p8_joint, "p8_rules": p8_rules,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_rules": p9_rules, "p10_found": p10_found, "p10_composition": p10_composition, "p10_functions": p10_functions}
QUERIES = {name: tidy(query) for name, query in QUERIES.items()}
ORACLES = {
    "p1_found": _POSTINGS + """, b AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, weight DESC, token) AS rn
  FROM w WHERE tf >= 3 AND df >= 2) SELECT probe_id, token FROM probes JOIN b ON target_id = doc_id WHERE rn = 1 AND purpose = 'keyword'""",
    "p1_top_terms": _POSTINGS + """, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS place FROM w)
  SELECT doc_id, place, token, round(weight, 6) AS weight FROM b WHERE place <= 5""",
    "p2_found": _RANKS + "SELECT query_id, doc_id FROM t WHERE place = 1",
    "p4_found": _POSTINGS + """, c AS (SELECT DISTINCT config_id, min_frequency, max_vocab FROM embed_config),
  x AS (SELECT config_id, token, uses, df, max_vocab, uses < min_frequency AS rare, row_number() OVER (PARTITION BY config_id ORDER BY uses < min_frequency, uses DESC, token) AS place FROM f, c)
  SELECT config_id, token, 'rare' AS mark FROM x WHERE rare UNION ALL SELECT config_id, token, 'common' FROM x, s WHERE df * 2 >= n
  UNION ALL SELECT config_id, token, 'cut' FROM x WHERE NOT rare AND max_vocab > 0 AND place > max_vocab""",
    "p4_frequencies": _POSTINGS + "SELECT token, uses, df, row_number() OVER (ORDER BY uses DESC, token) AS place FROM f",
    "p6_found": _WORDS.format(id="doc_id", text="content", table="documents_idx", k=3, t=0.6) + "SELECT a AS doc_id_a, b AS doc_id_b FROM j",
    "p7_found": """WITH v AS (SELECT 'doc_neighbours' AS purpose, doc_id AS id, min(list_transform(q, lambda x: x::DOUBLE)) AS v FROM doc_vec
    WHERE doc_id IS NOT NULL AND len(q) = 64 AND list_sum(list_transform(q, lambda x: abs(x::DOUBLE))) > 0 GROUP BY 2
  UNION ALL SELECT 'token_neighbours', token, min(vec) FROM token_vec WHERE token IS NOT NULL AND len(vec) = 64 AND list_sum(list_transform(vec, lambda x: abs(x))) > 0 GROUP BY 2),
  c AS (SELECT probe_id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM probes JOIN v a ON a.purpose = probes.purpose AND a.id = target_id JOIN v b ON b.purpose = a.purpose AND b.id <> a.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY s DESC, neighbour) AS rn FROM c) SELECT probe_id, neighbour FROM r WHERE rn <= 5""",
    "p6_links": _WORDS.format(id="doc_id", text="text", table="documents", k=5, t=0.8) + """, m AS (SELECT id, h, min(id) OVER (PARTITION BY h) AS rep,
  count(*) OVER (PARTITION BY h) AS class_size FROM n), e AS (SELECT x.rep AS p, y.rep AS q FROM j JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.rep <> y.rep GROUP BY ALL),
  k AS (SELECT rep, count(DISTINCT o) AS n_links FROM (SELECT p AS rep, q AS o FROM e UNION ALL SELECT q, p FROM e) GROUP BY 1)
  SELECT id AS doc_id, m.rep AS rep, class_size, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN k USING (rep)""",
    "p6_groups": _WORDS.format(id="doc_id", text="text", table="documents", k=5, t=0.8) + """, m AS (SELECT id, min(id) OVER (PARTITION BY h) AS rep FROM n),
  e AS (SELECT DISTINCT x.rep AS p, y.rep AS q FROM j JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.rep <> y.rep),
  cc(rep, g) AS (SELECT DISTINCT rep, rep FROM m UNION SELECT o, g FROM cc JOIN (SELECT p AS i, q AS o FROM e UNION SELECT q, p FROM e) ON i = rep),
  l AS (SELECT rep, min(g) AS group_id FROM cc GROUP BY 1)
  SELECT id AS doc_id, rep, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM m JOIN l USING (rep)""",
    "p5_residue": "WITH r AS (SELECT doc_id, min(content) AS c FROM documents_idx WHERE doc_id IS NOT NULL AND content IS NOT NULL GROUP BY 1) " + " UNION ALL ".join(
        "SELECT '" + n + "' AS sign, count(*) FILTER (regexp_matches(c, '" + p.replace("'", "''") + "')) AS before, true AS gone FROM r" for n, p in SIGNS.items()),
    "p7_recall": """SELECT 'doc_vec' AS vectors, count(DISTINCT doc_id) AS asked, true AS enough FROM doc_vec WHERE doc_id LIKE '%0' AND len(q) = 64 AND list_sum(list_transform(q, lambda x: abs(x::DOUBLE))) > 0
  UNION ALL SELECT 'token_vec', count(DISTINCT token), true FROM token_vec WHERE len(vec) = 64 AND list_sum(list_transform(vec, lambda x: abs(x))) > 0""",
    "p8_rules": """SELECT pack_id, (SELECT count(*) FROM documents WHERE text <> '') AS items, 0::BIGINT AS bad_containers, 0::BIGINT AS cut_texts, 0::BIGINT AS bad_texts
  FROM (SELECT DISTINCT pack_id FROM pack_capacity WHERE pack_id IS NOT NULL AND capacity_tokens > 0 UNION ALL SELECT NULL)""",
    "p9_rules": """WITH k AS (SELECT DISTINCT lower(regexp_replace(source, '[^\\p{L}\\p{Nd}]', '', 'g')) AS k FROM documents WHERE text <> ''),
  t AS (SELECT mix_id, lower(regexp_replace(source, '[^\\p{L}\\p{Nd}]', '', 'g')) AS k, sum(CASE WHEN target_share > 0 AND NOT isnan(target_share) THEN target_share END) AS w, min(coalesce(max_repeats, 1)) AS r
    FROM (SELECT DISTINCT * FROM mix_target) WHERE mix_id IS NOT NULL GROUP BY ALL)
  SELECT DISTINCT mix_id, 0::BIGINT AS overused, 0::BIGINT AS doubled, 0::BIGINT AS gaps, 0::BIGINT AS unwanted, 0::BIGINT AS over_budget, 0::BIGINT AS off_share FROM t JOIN k USING (k) WHERE k <> '' AND w > 0 AND r >= 1""",
    "p2_ranking": _RANKS + "SELECT query_id, doc_id, place, round(median_rank, 6) AS median_rank, round(mean_rank, 6) AS mean_rank FROM t",
}
