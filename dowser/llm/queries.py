"""Queries of the problems tagged llm, over the whole index tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dowser.llm import encoding, language, near_duplicates, neighbours, packing, quality, splitting, tokenizer
from dowser.tables import table

TEXTS = (("file_info", "content"), ("file_content_embedding", "chunk_text"))


def _pieces(rows: DataFrame, name: str, text: str) -> DataFrame:
    return splitting.split(rows, text, "id").select(
        F.lit(name).alias("src_table"), F.col("id").alias("row_id"), "chunk_index", "chunk_start", "chunk_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.mutual(neighbours.near(table(spark, sf_dir, "file_content_embedding"))).select("id_a", "id_b")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every vector and their distance, however far."""
    return neighbours.nearest(table(spark, sf_dir, "file_content_embedding"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, representative) of every row whose vector others have too, in any length."""
    return neighbours.copies(table(spark, sf_dir, "file_content_embedding"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a second piece."""
    found = [_pieces(table(spark, sf_dir, name), name, text).where(F.col("chunk_index") == 1).select("src_table", "row_id") for name, text in TEXTS]
    return found[0].unionByName(found[1]).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized row, each id once; of several oversized versions the latest is cut."""
    every = []
    for name, text in TEXTS:
        rows = table(spark, sf_dir, name)
        version = F.struct(F.col("update_time" if "update_time" in rows.columns else "create_time"), F.xxhash64(text))
        big = rows.where((F.char_length(text) > splitting.LIMIT) & (splitting.size(F.col(text)) > splitting.LIMIT))
        every.append(_pieces(big.groupBy("id").agg(F.max_by(text, version).alias(text)), name, text))
    return every[0].unionByName(every[1])


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, rows_cut, too_long, cut_wrong, covered): of p3_pieces, how many rows were cut, how many pieces are
    above the limit or don't begin with the end of the one before, and the characters of all texts put together
    again from their pieces."""
    pieces = p3_pieces(spark, sf_dir)
    end = F.col("chunk_start") + F.char_length("chunk_text")
    before = F.lag(F.struct(end.alias("end"), F.col("chunk_text").alias("text"))).over(Window.partitionBy("src_table", "row_id").orderBy("chunk_index"))
    joined = pieces.withColumn("before", before)
    fresh = F.when(F.col("before").isNull(), F.char_length("chunk_text")).otherwise(end - F.col("before.end"))
    wrong = F.col("before").isNotNull() & ((F.col("before.end") - F.col("chunk_start") != splitting.OVERLAP)
                                           | (F.right(F.col("before.text"), F.lit(splitting.OVERLAP)) != F.left(F.col("chunk_text"), F.lit(splitting.OVERLAP))))
    return joined.groupBy("src_table").agg(
        F.countDistinct("row_id").alias("rows_cut"), F.sum(F.when(F.char_length("chunk_text") > splitting.LIMIT, 1).otherwise(0)).alias("too_long"),
        F.sum(F.when(wrong, 1).otherwise(0)).alias("cut_wrong"), F.sum(fresh).alias("covered"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs(table(spark, sf_dir, "file_info"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, share): the similar pairs of representatives; p4_members says which rows they stand for."""
    return near_duplicates.similar(table(spark, sf_dir, "file_info")).select("a", "b", F.round("share", 6).alias("share"))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, rep): every row with enough words and the least id with an equal content."""
    return near_duplicates.members(near_duplicates.enough_words(table(spark, sf_dir, "file_info"), "id", "content"), "id", "content")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "file_info"))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_rows, n_links): rows that take part, and the ends of all links of their representatives, out of p4_groups."""
    return p4_groups(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("id") == F.col("rep"), F.col("links")).otherwise(0)).alias("n_links"))


def _garbled(spark: SparkSession, sf_dir: str, restored: bool) -> DataFrame:
    frames = [(table(spark, sf_dir, name), "id", text) for name, text in TEXTS]
    model = encoding.fit_on(frames)
    found = [encoding.find(df, model, key, text, restored).select(F.lit(name).alias("src_table"), F.col(key).alias("row_id"), "*").drop(key)
             for (df, key, text), (name, _) in zip(frames, TEXTS, strict=True)]
    return found[0].unionByName(found[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir, False).select("src_table", "row_id").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain and the restored text of every garbled row; `whole`: nothing was lost."""
    return _garbled(spark, sf_dir, True).dropDuplicates(["src_table", "row_id"])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, language, confidence, mixed, other, label, known): every document, and every file under a root
    set to English, with the label it comes with. known: the label is of a language that the model can tell."""
    docs, files = table(spark, sf_dir, "documents"), table(spark, sf_dir, "file_info")
    model = language.fit_on(docs)
    english = table(spark, sf_dir, "indexer_setting").where("lower(trim(coalesce(file_content_language, ''))) <> 'multilingual'")
    one = language.documents(docs.withColumn("label", language.named(F.col("lang"))), model, "doc_id", "text", ["label"]).withColumnRenamed("doc_id", "row_id")
    two = language.documents(language.under_roots(files, english).withColumn("label", F.lit("en")), model, "id", "content", ["label"]).withColumnRenamed("id", "row_id")
    both = one.select(F.lit("documents").alias("src_table"), "*").unionByName(two.select(F.lit("file_info").alias("src_table"), "*"))
    return both.withColumn("known", F.coalesce(F.col("label").isin(*model.languages), F.lit(False)))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).dropDuplicates(["src_table", "row_id"])


def p6_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.stretches(docs, language.fit_on(docs), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another language than the label's must be told with more confidence if the label's is none that the model knows."""
    other = F.col("label").isNull() | ((F.col("label") != F.col("language")) & (F.col("known") | (F.col("confidence") >= language.SURE)))
    return _languages(spark, sf_dir).where((F.col("language") != language.UND) & (F.col("mixed") | other)).select("src_table", "row_id").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the tokens in them and the unused share."""
    filled = p8_pack(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return filled.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"),
                      (1 - F.sum("n") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("unused"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, without_tokens, overfull, overlapping, divided_in_vain) of p8_pack: containers that hold more than
    their capacity or two pieces at one place, and texts that fit but were divided, of which there are none."""
    packed = p8_pack(spark, sf_dir)
    order = Window.partitionBy("container_id").orderBy("container_offset")
    placed = packed.where("container_id is not null").withColumn("before", F.lag(F.col("container_offset") + F.col("n_tokens")).over(order))
    bins = placed.agg(F.count_if(F.col("container_offset") + F.col("n_tokens") > packing.CAPACITY).alias("overfull"), F.count_if(F.col("container_offset") < F.col("before")).alias("overlapping"))
    rows = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") == 0).alias("without_tokens"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("divided_in_vain"))
    names = ("documents", "without_tokens", "overfull", "overlapping", "divided_in_vain")
    return rows.unionByName(bins, allowMissingColumns=True).agg(*(F.sum(n).alias(n) for n in names))


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the label of every document."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_quality(spark, sf_dir).where("label = 'junk'").select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_copies": p2_copies, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_totals": p3_totals, "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_members": p4_members, "p4_groups": p4_groups, "p4_totals": p4_totals, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_languages": p6_languages, "p6_stretches": p6_stretches, "p7_ids": p7_ids, "p8_pack": p8_pack, "p8_fill": p8_fill, "p8_totals": p8_totals,
           "p9_quality": p9_quality, "p9_found": p9_found}

#: Sizes as TESTDATA.md defines them.
_SIZE = "length(regexp_replace(regexp_replace({0}, '[\\r\\n]+', chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'))"
_TRIPLES = """
with t as (select id, any_value(content) as content from file_info where content is not null group by id),
w as (select id, list_filter(regexp_split_to_array(lower(content), '[ \\t\\r\\n]+'), lambda x: x <> '') as w from t),
g as (select id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 30),
e as (select id, len(g) as n, unnest(g) as gram from g),
shared as (select a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as o from e a join e b on a.gram = b.gram and a.id < b.id group by all),
pairs as (select id_a, id_b from shared where o >= 0.6 * (na + nb - o))
"""
_REPS = _TRIPLES + """, t30 as (select t.id, t.content from t join w on w.id = t.id where len(w.w) >= 30),
member as (select id, min(id) over (partition by content) as rep from t30),
linked as (select id_a as a, id_b as b, o / (na + nb - o) as share from shared where o >= 0.6 * (na + nb - o) 
  and id_a in (select id from member where id = rep) and id_b in (select id from member where id = rep))
"""
#: Every vector against every other.
_MUTUAL = """
with v as (select id, any_value(embedding)::float[64] as e from file_content_embedding where len(embedding) = 64
  and list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0 group by id),
d as (select a.id as a, b.id as b, 1 - array_cosine_similarity(a.e, b.e) as d from v a join v b on a.id <> b.id),
r as (select a, b, d, row_number() over (partition by a order by d, b) as n from d where d <= 0.06)
select x.a as id_a, x.b as id_b from r x join r y on x.a = y.b and x.b = y.a where x.n <= 5 and y.n <= 5 and x.a < x.b and x.d <= 0.05
"""
SQL = {
    "p2_found": _MUTUAL,
    "p8_totals": "select count(*) as documents, count(*) filter (where coalesce(text, '') = '') as without_tokens, 0 as overfull, 0 as overlapping, 0 as divided_in_vain from documents",
    "p4_pairs": _REPS + "select a, b, round(share, 6) as share from linked",
    "p4_members": _REPS + "select id, rep from member",
    "p4_totals": _REPS + "select (select count(*) from member) as n_rows, 2 * (select count(*) from linked) as n_links",
    "p4_found": _TRIPLES + "select id_a, id_b from pairs",
    "p3_totals": " union all ".join(
        f"select '{name}' as src_table, count(*) as rows_cut, 0 as too_long, 0 as cut_wrong, sum(n) as covered from (select id, any_value({_SIZE.format(text)}) as n from {name} group by id) where n > {splitting.LIMIT}"
        for name, text in TEXTS),
    "p3_found": " union ".join(
        f"select '{name}' as src_table, id as row_id from {name} where {_SIZE.format(text)} > {splitting.LIMIT}" for name, text in TEXTS),
}
