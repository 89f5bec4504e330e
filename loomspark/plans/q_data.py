"""Sources, sinks, joins, sets, batches, monitoring and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text
from loomspark.operators import batches, quality, sampling
from loomspark.plans.q_rollouts import _r10, rounded
from loomspark.plans.q_text import norm
from loomspark.plans.registry import query
from loomspark.session import checkpoint, ensure_checkpoint_dir, load
from loomspark.sources import files
from loomspark.streaming import monitor


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src7_parquet_scan", "SELECT sample_id, split, domain FROM recovery_pool")
def src7(spark: SparkSession, d: str) -> DataFrame:
    return files.read_parquet(spark, f"{d}/recovery_pool.parquet", ["sample_id", "split", "domain"])


@query("src8_named_split", "SELECT sample_id FROM recovery_pool WHERE split = 'val'")
def src8(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").filter("split = 'val'").select("sample_id")


@query("src6_projected_shards", "SELECT row_id, prompt FROM source_rows")
def src6(spark: SparkSession, d: str) -> DataFrame:
    return files.read_parquet(spark, f"{d}/source_rows.parquet", ["row_id", "prompt"], skip_corrupt=True)


#: Benchmarks of the catalogue: name, and whether its answers are graded.
CATALOGUE = [("contest_a", True), ("contest_b", True), ("code_window", False), ("science_hard", True), ("constraint_eval", False)]
_WANTED = ("contest_a", "science_hard", "code_window")


@query("src10_benchmark_catalogue", f"SELECT item_id, benchmark, benchmark_index, CASE WHEN benchmark IN {tuple(n for n, g in CATALOGUE if g)} THEN answer END AS answer, benchmark IN {tuple(n for n, g in CATALOGUE if g)} AS graded FROM benchmark_items WHERE benchmark IN {_WANTED}")
def src10(spark: SparkSession, d: str) -> DataFrame:
    """Items of the benchmarks that are included, with their answers where these are graded; unknown benchmarks fail."""
    return files.catalogue(load(spark, d, "benchmark_items"), CATALOGUE, _WANTED).select("item_id", "benchmark", "benchmark_index", "answer", "graded")


@query("src5_jsonl_round_trip", "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_id % 3 <> 0")
def src5(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written and read again; lines that are no JSON are skipped."""
    path = _scratch(spark, "jsonl")
    e = load(spark, d, "events")
    good = F.to_json(F.struct("event_id", "user_id", F.round("value", 6).alias("value")))
    e.select(F.when(F.col("event_id") % 3 != 0, good).otherwise("{broken").alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id bigint, user_id bigint, value double").filter("event_id is not null")


@query("src9_multi_file_concat", "SELECT event_id FROM events")
def src9(spark: SparkSession, d: str) -> DataFrame:
    a, b = _scratch(spark, "part"), _scratch(spark, "part")
    e = load(spark, d, "events").select("event_id")
    e.filter("event_id % 2 = 0").write.json(a)
    e.filter("event_id % 2 = 1").write.json(b)
    return files.read_jsonl(spark, [a, b], "event_id bigint")


@query("src12_subsampled_concat", "SELECT sample_id FROM (SELECT DISTINCT sample_id FROM recovery_pool WHERE split IN ('sft', 'opd') AND sample_id IS NOT NULL) ORDER BY sha256(concat('m:', sample_id)), sample_id LIMIT 200")
def src12(spark: SparkSession, d: str) -> DataFrame:
    pool = load(spark, d, "recovery_pool").filter("split in ('sft', 'opd') and sample_id is not null").select("sample_id").distinct()
    return sampling.quota_sample(pool, 200, sampling.stable_rank("m", F.col("sample_id")), tie="sample_id").select("sample_id")


@query("src13_nested_fields", "SELECT DISTINCT sample_id, reward_model.style AS style, extra_info.original_id AS original_id FROM recovery_pool WHERE split = 'opd'")
def src13(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").filter("split = 'opd'").select("sample_id", F.col("reward_model.style").alias("style"), F.col("extra_info.original_id").alias("original_id")).distinct()


@query("src11_cached_rehydrate", "SELECT row_id, ord FROM source_rows")
def src11(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import StructType

    rows = load(spark, d, "source_rows").select("row_id", "ord")
    return files.cached_or(spark, _scratch(spark, "cache"), StructType.fromDDL("row_id bigint, ord bigint"), lambda: rows)


@query("snk1_parquet_order", "SELECT row_id, row_number() OVER (ORDER BY ord, row_id) - 1 AS place FROM source_rows")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "ordered")
    files.write_ordered(load(spark, d, "source_rows").select("row_id", "ord"), path, ["ord", "row_id"])
    return sampling.global_rank(spark.read.parquet(path), ["ord", "row_id"], "place").select("row_id", "place")


@query("snk6_csv_round_trip", "SELECT n_nationkey, n_name FROM nation")
def snk6(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "csv")
    load(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path, header=True)
    return spark.read.schema("n_nationkey int, n_name string").csv(path, header=True)


@query("snk8_flatten_json", "SELECT DISTINCT sample_id, reward_model.ground_truth AS reward_model__ground_truth, reward_model.style AS reward_model__style FROM recovery_pool WHERE split = 'opd'")
def snk8(spark: SparkSession, d: str) -> DataFrame:
    return files.flatten(load(spark, d, "recovery_pool").filter("split = 'opd'").select("sample_id", "reward_model").distinct(), "__")


_COVER = "SELECT s AS block, s * 250 AS start, least((s + 1) * 250, n) AS stop FROM (SELECT count(*) AS n FROM source_rows), unnest(range((n + 249) // 250)) r(s)"


@query("snk10_missing_shards", f"SELECT start, stop FROM ({_COVER}) WHERE block % 3 <> 1")
def snk10(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of all rows that no written shard covers as a whole; here every third range has one, and others are short by a row."""
    rows = load(spark, d, "source_rows").select("ord")
    path = _scratch(spark, "ranges")
    block = F.floor(F.col("ord") / 250)
    rows.withColumn("block", block).filter((F.col("block") % 3 == 1) | ((F.col("block") % 3 == 2) & (F.col("ord") % 250 > 0))).write.partitionBy("block").json(path)
    have = spark.read.schema("ord bigint, block bigint").json(path).groupBy("block").agg(F.min("ord").alias("start"), (F.max("ord") + 1).alias("stop"), F.countDistinct("ord").alias("n"))
    return files.missing_shards(have.filter("n = stop - start").select("start", "stop"), rows.count(), 250)


_DIGEST = "WITH b AS (SELECT ord // 1024 AS block, sha256(string_agg(row_id::VARCHAR, chr(10) ORDER BY ord, row_id)) AS d FROM source_rows GROUP BY block) SELECT sha256(string_agg(d, chr(10) ORDER BY block)) AS digest, count(*) AS blocks FROM b"


@query("snk11_ordered_digest", _DIGEST)
def snk11(spark: SparkSession, d: str) -> DataFrame:
    return files.ordered_digest(load(spark, d, "source_rows"), "row_id", "ord")


@query("snk14_split_identity", "SELECT split, split <> 'val' AS reused, count(*) AS n FROM (SELECT DISTINCT sample_id, split FROM recovery_pool WHERE sample_id IS NOT NULL) GROUP BY split")
def snk14(spark: SparkSession, d: str) -> DataFrame:
    """Splits are written again only if the digest of their ids differs from the one that is stored; here that of `val` does."""
    pool = load(spark, d, "recovery_pool").filter("sample_id is not null").select("sample_id", "split").distinct()
    placed = checkpoint(sampling.interleave(pool, "split", F.col("sample_id"), None).withColumn("place", F.col("turn") - 1))
    path, out = _scratch(spark, "digests"), _scratch(spark, "splits")
    now = checkpoint(files.ordered_digest(placed, "sample_id", "place", ["split"]).select("split", "digest"))
    now.withColumn("digest", F.when(F.col("split") == "val", "stale").otherwise(F.col("digest"))).write.json(path)
    stored = spark.read.schema("split string, digest string").json(path)
    state = checkpoint(now.join(stored.withColumnRenamed("digest", "old"), "split", "left").select("split", F.coalesce(F.col("digest") == F.col("old"), F.lit(False)).alias("reused")))
    placed.join(state.filter("not reused"), "split", "left_semi").select("split", "sample_id").write.partitionBy("split").parquet(out)
    rewritten = spark.read.schema("sample_id string, split string").parquet(out).groupBy("split").agg(F.count("*").alias("written"))
    sizes = pool.groupBy("split").agg(F.count("*").alias("n"))
    return state.join(sizes, "split").join(rewritten, "split", "left").select("split", "reused", F.when(F.col("reused"), F.col("n")).otherwise(F.col("written")).alias("n"))


_PROMPTS = "SELECT benchmark, string_agg(sha256(text), chr(10) ORDER BY benchmark_index, item_id) AS p, string_agg(coalesce(answer, ''), chr(10) ORDER BY benchmark_index, item_id) AS l FROM benchmark_items GROUP BY benchmark"


@query("snk12_task_signature", f"SELECT benchmark, sha256('v1' || chr(1) || benchmark || chr(1) || 'model' || chr(1) || 'full' || chr(1) || sha256(p) || chr(1) || sha256(l) || chr(1) || '{{\"n\":8}}') AS signature FROM ({_PROMPTS})")
def snk12(spark: SparkSession, d: str) -> DataFrame:
    """The signature of each task: schema, task, model, profile, prompts, labels and sampling."""
    b = load(spark, d, "benchmark_items").groupBy("benchmark").agg(F.array_sort(F.collect_list(F.struct("benchmark_index", "item_id", F.sha2("text", 256).alias("p"), F.coalesce("answer", F.lit("")).alias("l")))).alias("r"))
    part = lambda f: F.sha2(F.array_join(F.transform("r", lambda x: x[f]), "\n"), 256)
    return b.select("benchmark", F.sha2(F.concat_ws("\x01", F.lit("v1"), "benchmark", F.lit("model"), F.lit("full"), part("p"), part("l"), F.lit('{"n":8}')), 256).alias("signature"))


@query("snk13_cache_hits", "SELECT benchmark, count(*) FILTER (benchmark_index % 2 = 0) AS hits, count(*) AS asked FROM benchmark_items GROUP BY benchmark")
def snk13(spark: SparkSession, d: str) -> DataFrame:
    """Wanted results whose signature stands in the manifest."""
    b = load(spark, d, "benchmark_items").withColumn("s", files.signature(F.lit("v1"), F.col("benchmark"), F.col("text"), F.col("item_id")))
    manifest = b.filter("benchmark_index % 2 = 0").select("s", F.lit(1).alias("hit"))
    return b.join(manifest, "s", "left").groupBy("benchmark").agg(F.count("hit").alias("hits"), F.count("*").alias("asked"))


@query("snk15_partitioned_dump", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def snk15(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "dump")
    load(spark, d, "events").select("event_type", "event_id").write.partitionBy("event_type").json(path)
    return spark.read.json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("snk5_jsonl_append", "SELECT event_id, event_type FROM events")
def snk5(spark: SparkSession, d: str) -> DataFrame:
    """All events, written in one dump and appended in two."""
    path = _scratch(spark, "append")
    e = load(spark, d, "events").select("event_id", "event_type")
    for k in range(3):
        e.filter(F.col("event_id") % 3 == k).write.mode("append").json(path)
    return spark.read.schema("event_id bigint, event_type string").json(path)


@query("join4_positional_lookup", "SELECT s.row_id, coalesce(b.text, s.prompt) AS question FROM source_rows s LEFT JOIN benchmark_items b ON s.domain = 'math' AND b.benchmark = 'contest_a' AND b.benchmark_index = s.ord % 100")
def join4(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders (data set, row) replaced by public rows; other rows pass."""
    s = load(spark, d, "source_rows").select("row_id", "prompt", F.when(F.col("domain") == "math", "contest_a").alias("benchmark"), (F.col("ord") % 100).cast("int").alias("benchmark_index"))
    b = load(spark, d, "benchmark_items").select("benchmark", "benchmark_index", "text")
    return s.join(b, ["benchmark", "benchmark_index"], "left").select("row_id", F.coalesce("text", "prompt").alias("question"))


@query("join5_zip_by_position", "WITH r AS (SELECT response_id, any_value(messages) AS m FROM teacher_responses WHERE len(messages) > 0 GROUP BY response_id) SELECT response_id, i AS position, m[i + 1].role AS role, m[i + 2].role AS next_role FROM (SELECT *, unnest(range(len(m))) AS i FROM r)")
def join5(spark: SparkSession, d: str) -> DataFrame:
    """Turns zipped by position with the turns after them; the last has none."""
    m = load(spark, d, "teacher_responses").filter("size(messages) > 0").groupBy("response_id").agg(F.first("messages.role").alias("r"))
    z = F.arrays_zip(F.col("r").alias("role"), F.slice("r", F.lit(2), F.size("r")).alias("next_role"))
    return m.select("response_id", F.posexplode(z).alias("position", "z")).select("response_id", F.col("position").cast("bigint").alias("position"), "z.role", "z.next_role")


@query("join6_last_response_wins", "SELECT sample_id, arg_max(response_id, generated_at) AS response_id FROM (SELECT sample_id, response_id, max(generated_at) AS generated_at FROM teacher_responses WHERE sample_id IS NOT NULL GROUP BY ALL) GROUP BY sample_id")
def join6(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "teacher_responses").filter("sample_id is not null").groupBy("sample_id", "response_id").agg(F.max("generated_at").alias("at"))
    return t.groupBy("sample_id").agg(F.max_by("response_id", "at").alias("response_id"))


@query("join9_column_union", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def join9(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return batches.union_columns(o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@query("join10_sidecar", "SELECT c_custkey, o.n, o.total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def join10(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    return load(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("set1_concat_samples", "SELECT row_id, domain FROM source_rows WHERE domain IN ('math', 'code')")
def set1(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "source_rows").select("row_id", "domain")
    return s.filter("domain = 'math'").unionByName(s.filter("domain = 'code'"))


@query("set2_shard_concat", _DIGEST)
def set2(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "source_rows").select("row_id", "ord")
    return files.ordered_digest(s.filter("row_id % 2 = 0").unionByName(s.filter("row_id % 2 = 1")), "row_id", "ord")


@query("set3_batch_concat", "SELECT event_type, count(*) AS n, round(sum(value), 5) AS total, count(props) AS with_props, 'a,b' AS origins FROM (SELECT event_type, value, CASE WHEN event_id % 2 = 0 THEN props END AS props FROM events) GROUP BY event_type")
def set3(spark: SparkSession, d: str) -> DataFrame:
    """Batches put together by rows: columns that one lacks are null, facts about them are merged, conflicting ones fail."""
    e = load(spark, d, "events")
    both, facts = batches.concat([(e.filter("event_id % 2 = 0"), {"origin_a": "a", "scale": 1}), (e.filter("event_id % 2 = 1").drop("props"), {"origin_b": "b", "scale": 1})])
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"), F.count("props").alias("with_props"), F.lit(",".join(v for k, v in sorted(facts.items()) if k.startswith("origin"))).alias("origins"))


@query("set5_hash_intersection", f"SELECT h FROM (SELECT sha256({norm('prompt')}) AS h FROM recovery_pool WHERE split = 'sft' AND prompt IS NOT NULL INTERSECT SELECT sha256({norm('prompt')}) FROM recovery_pool WHERE split <> 'sft' AND prompt IS NOT NULL)")
def set5(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "recovery_pool").filter("prompt is not null").select("split", text.prompt_hash(F.col("prompt")).alias("h"))
    return p.filter("split = 'sft'").select("h").intersect(p.filter("split <> 'sft'").select("h"))


@query("set9_cross_split_ids", "SELECT count(*) AS shared FROM (SELECT sample_id FROM recovery_pool WHERE split = 'sft' INTERSECT SELECT sample_id FROM recovery_pool WHERE split = 'opd')")
def set9(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "recovery_pool")
    return p.filter("split = 'sft'").select("sample_id").intersect(p.filter("split = 'opd'").select("sample_id")).agg(F.count("*").alias("shared"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), "o_custkey", "o_orderstatus")


@query("bat1_select", "SELECT o_orderkey AS ord, o_custkey FROM orders")
def bat1(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("ord", "o_custkey")


@query("bat2_select_rows", "SELECT o_orderkey AS ord FROM orders WHERE o_orderkey IN (1, 5, 8, 13, 21) OR o_orderstatus = 'P'")
def bat2(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    wanted = spark.createDataFrame([(i,) for i in (1, 5, 8, 13, 21)], "ord bigint")
    return r.join(F.broadcast(wanted), "ord", "left_semi").select("ord").union(r.filter("o_orderstatus = 'P'").select("ord")).distinct()


@query("bat3_slice", "SELECT o_orderkey AS ord FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 9000 AND (o_orderkey - 100) % 7 = 0")
def bat3(spark: SparkSession, d: str) -> DataFrame:
    return batches.slice_rows(_rows(spark, d), 100, 9000, 7).select("ord")


@query("bat4_pop", "SELECT o_orderkey AS ord, o_orderstatus FROM orders")
def bat4(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).drop("o_custkey")


@query("bat5_rename", "SELECT o_orderkey AS ord, o_custkey AS uid FROM orders")
def bat5(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).withColumnsRenamed({"o_custkey": "uid"}).select("ord", "uid")


@query("bat6_union", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, l.n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey")
def bat6(spark: SparkSession, d: str) -> DataFrame:
    """The columns of another batch beside those of this; a column that both have must agree."""
    o = load(spark, d, "orders")
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    other = o.select("o_orderkey", "o_custkey", "o_orderstatus").join(n, "o_orderkey", "left")
    return batches.union_columns(o.select("o_orderkey", "o_custkey", "o_totalprice"), other, "o_orderkey")


@query("bat7_chunk", "SELECT item_id - 1 AS ord, ((item_id - 1) // 61)::INTEGER AS chunk FROM benchmark_items")
def bat7(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "benchmark_items").select((F.col("item_id") - 1).alias("ord"))
    return batches.chunk(rows, rows.count(), 5)


@query("bat8_split", "SELECT o_orderkey AS ord, (o_orderkey // 128)::INTEGER AS part FROM orders")
def bat8(spark: SparkSession, d: str) -> DataFrame:
    return batches.split_rows(_rows(spark, d).select("ord"), 128)


@query("bat9_concat", "SELECT o_orderkey, o_orderkey % 3 AS origin FROM orders")
def bat9(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("origin"))
    return batches.concat([(o.filter(F.col("origin") == k), {}) for k in range(3)])[0]


@query("bat10_reorder", "SELECT o_orderkey AS ord, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders")
def bat10(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    order = sampling.global_rank(r.select("o_custkey", "ord"), ["o_custkey", "ord"], "place")
    return r.select("ord").join(order.select("ord", "place"), "ord")


@query("bat11_repeat", "SELECT n_nationkey::BIGINT AS ord, r AS copy, n_nationkey::BIGINT * 3 + r AS place FROM nation, range(3) t(r)")
def bat11(spark: SparkSession, d: str) -> DataFrame:
    return batches.repeat_rows(load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("ord")), 3)


@query("bat12_repeat_each", "SELECT n_nationkey, c AS copy FROM nation, range(1, 6) t(c) WHERE c <= n_regionkey")
def bat12(spark: SparkSession, d: str) -> DataFrame:
    return batches.repeat_each(load(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey")).select("n_nationkey", "copy")


@query("bat13_unfold_chunks", "SELECT vec_id, p::INTEGER AS piece, round(list_sum(list_transform(embedding[p * 16 + 1:p * 16 + 16], lambda x: x::DOUBLE)), 5) AS total FROM embeddings, range(4) t(p)")
def bat13(spark: SparkSession, d: str) -> DataFrame:
    u = batches.unfold_chunks(load(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    return u.select("vec_id", "piece", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("bat14_pad", "SELECT item_id - 1 AS ord, false AS is_pad FROM benchmark_items UNION ALL SELECT item_id - 1 + 305, true FROM benchmark_items WHERE item_id <= 15")
def bat14(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "benchmark_items").select((F.col("item_id") - 1).alias("ord"))
    return batches.pad_to_divisor(rows, rows.count(), 32)


@query("bat15_fold", "SELECT o_orderkey // 8 AS batch, array_to_string(list(o_custkey ORDER BY o_orderkey), ',') AS members FROM orders GROUP BY batch")
def bat15(spark: SparkSession, d: str) -> DataFrame:
    g = F.array_sort(F.collect_list(F.struct("ord", "o_custkey")))
    return _rows(spark, d).groupBy(F.floor(F.col("ord") / 8).alias("batch")).agg(F.array_join(F.transform(g, lambda x: x["o_custkey"]), ",").alias("members"))


@query("bat16_mini_batches", "SELECT e::INTEGER AS epoch, (o_orderkey // 64)::INTEGER AS batch, count(*) AS n FROM orders, range(2) t(e) WHERE o_orderkey // 64 < ((SELECT max(o_orderkey) FROM orders) + 1) // 64 GROUP BY ALL")
def bat16(spark: SparkSession, d: str) -> DataFrame:
    return batches.batches_of(_rows(spark, d), 64, 2).groupBy("epoch", "batch").agg(F.count("*").alias("n"))


@query("bat17_collate", "SELECT l_orderkey // 16 AS batch, max(n) AS width, array_to_string(list_sort(list(row)), ';') AS rows FROM (SELECT l_orderkey, n, concat(lpad(l_orderkey::VARCHAR, 12, '0'), ':', array_to_string(list_concat(a, list_transform(range(w - n), lambda i: -1)), ',')) AS row FROM (SELECT *, max(n) OVER (PARTITION BY l_orderkey // 16) AS w FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a, count(*) AS n FROM lineitem GROUP BY l_orderkey))) GROUP BY batch")
def bat17(spark: SparkSession, d: str) -> DataFrame:
    """Samples of different lengths stacked into batches, each padded to the longest of its batch."""
    s = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    stacked = batches.collate(s.withColumn("batch", F.floor(F.col("l_orderkey") / 16)), "batch", "l_orderkey", "a", F.lit(-1))
    line = F.transform("rows", lambda r: F.concat(F.lpad(r["key"].cast("string"), 12, "0"), F.lit(":"), F.array_join(r["values"].cast("array<string>"), ",")))
    return stacked.select("batch", F.col("width").cast("bigint").alias("width"), F.array_join(line, ";").alias("rows"))


@query("bat18_dict_of_lists", "SELECT array_to_string(list(r_name ORDER BY r_regionkey), ',') AS names, array_to_string(list(r_regionkey ORDER BY r_regionkey), ',') AS keys FROM region")
def bat18(spark: SparkSession, d: str) -> DataFrame:
    g = F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))
    r = load(spark, d, "region").agg(g.alias("g"))
    return r.select(F.array_join(F.col("g.r_name"), ",").alias("names"), F.array_join(F.col("g.r_regionkey").cast("array<string>"), ",").alias("keys"))


_PARTS = "[CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE ELSE value END, {other}]"


@query("bat19_null_safe_equal", f"SELECT event_id, {_PARTS.format(other='user_id')} IS NOT DISTINCT FROM {_PARTS.format(other='CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END')} AS same FROM events")
def bat19(spark: SparkSession, d: str) -> DataFrame:
    """Equality of nested values, with NaN equal to NaN and null to null only."""
    k, u = F.col("event_id"), F.col("user_id").cast("double")
    first = F.when(k % 3 == 0, float("nan")).otherwise(F.col("value"))
    other = F.when(k % 5 == 0, None).when(k % 7 == 0, u + 1).otherwise(u)
    return load(spark, d, "events").select("event_id", F.array(first, u).eqNullSafe(F.array(first, other)).alias("same"))


@query("bat20_pad_array", "SELECT l_orderkey AS seq, array_to_string(list_concat(list(l_linenumber ORDER BY l_linenumber), [0, 0, 0, 0, 0])[1:5], ',') AS padded FROM lineitem GROUP BY l_orderkey")
def bat20(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    return a.select("seq", F.array_join(batches.pad_array(F.col("a"), 5, F.lit(0)), ",").alias("padded"))


#: Rows of a batch that is balanced as one; the last batch is shorter.
BATCH_ROWS = 256


def _customer_batches(spark: SparkSession, d: str) -> DataFrame:
    """All customers in batches by their place in the order of the key."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("size"))
    return batches.split_rows(sampling.global_rank(c, ["k"], "ord"), BATCH_ROWS).select(F.col("part").alias("g"), "k", "size")


@query("srt13_karmarkar_karp")
def srt13(spark: SparkSession, d: str) -> DataFrame:
    return batches.balanced_parts(_customer_batches(spark, d), "g", "k", "size", 4)


@query("srt14_greedy_parts")
def srt14(spark: SparkSession, d: str) -> DataFrame:
    return batches.balanced_parts(_customer_batches(spark, d), "g", "k", "size", 4, "greedy")


@query("srt15_token_budget")
def srt15(spark: SparkSession, d: str) -> DataFrame:
    return batches.balanced_parts(_customer_batches(spark, d), "g", "k", "size", 20_000, "budget")


@query("srt18_rank_balance")
def srt18(spark: SparkSession, d: str) -> DataFrame:
    """The new order of each batch, in which every rank's rows stand together and all ranks have about the same load."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("part", "k")) - 1  # a batch has a bounded number of rows
    return srt13(spark, d).select("g", "k", F.col("part").alias("rank"), place.alias("place"))


_RUNS = "r AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("step"), "value")


_EMA = f"WITH RECURSIVE {_RUNS}, e(run, step, average) AS (SELECT run, step, value FROM r WHERE step = 1 UNION ALL SELECT r.run, r.step, 0.9 * e.average + (1 - 0.9) * r.value FROM e JOIN r ON r.run = e.run AND r.step = e.step + 1)"


@query("win5_ema", f"{_EMA} SELECT run, step, {_r10('average', 'average')} FROM e")
def win5(spark: SparkSession, d: str) -> DataFrame:
    a = runs(spark, d).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("a"))
    e = a.select("run", F.posexplode(monitor.ema(F.col("a.value"))).alias("p", "average"))
    return rounded(e.select("run", (F.col("p") + 1).cast("bigint").alias("step"), "average"), 10)


_PLATEAU = f"""WITH RECURSIVE {_RUNS}, e(run, step, average, best, stale, stopped) AS (SELECT run, step, value, value, 0, -1::BIGINT FROM r WHERE step = 1
UNION ALL SELECT run, step, a, CASE WHEN watch AND better THEN a ELSE best END, CASE WHEN NOT watch THEN stale WHEN better THEN 0 ELSE stale + 1 END, CASE WHEN watch AND NOT better AND stale + 1 >= 3 THEN step ELSE stopped END
FROM (SELECT *, a - best > 0.01 * abs(best) AS better FROM (SELECT r.run, r.step, 0.9 * e.average + (1 - 0.9) * r.value AS a, best, stale, stopped, r.step >= 20 AND r.step % 10 = 0 AND stopped < 0 AS watch FROM e JOIN r ON r.run = e.run AND r.step = e.step + 1)))
SELECT run, step, round(average, 7) + 0.0 AS average, round(best, 7) + 0.0 AS best, stale, stopped FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1"""


@query("win6_plateau", _PLATEAU)
def win6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monitor.plateau(runs(spark, d)))


@query("str1_plateau_stream", _PLATEAU)
def str1(spark: SparkSession, d: str) -> DataFrame:
    """The monitor on a stream of the stored runs, a run in one file; its last states equal those of the fold."""
    path = _scratch(spark, "runs")
    runs(spark, d).repartition("run").sortWithinPartitions("run", "step").write.parquet(path)
    sink = f"plateau_{uuid.uuid4().hex}"
    stream = monitor.plateau_stream(spark.readStream.schema("run bigint, step bigint, value double").parquet(path))
    stream.writeStream.format("memory").queryName(sink).outputMode("update").option("checkpointLocation", _scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.table(sink))


@query("str3_shard_resume", "SELECT (event_id % 8)::INTEGER AS shard, count(*) AS rows, event_id % 8 IN (1, 4, 6) AS resumed FROM events GROUP BY ALL")
def str3(spark: SparkSession, d: str) -> DataFrame:
    """Work by shards, resumed: shards that are whole are kept, the others are done and appended; here three are there already, and one is cut short."""
    path = _scratch(spark, "shards")
    e = load(spark, d, "events").select("event_id", (F.col("event_id") % 8).cast("int").alias("shard"))
    wanted = e.groupBy("shard").agg(F.count("*").alias("n"))
    e.filter(F.col("shard").isin(1, 4, 6) | ((F.col("shard") == 5) & (F.col("event_id") % 16 == 5))).write.partitionBy("shard").json(path)

    def done() -> DataFrame:
        return spark.read.schema("event_id bigint, shard int").json(path).distinct().groupBy("shard").agg(F.count("*").alias("rows"))

    whole = checkpoint(wanted.join(done(), "shard").filter("rows = n").select("shard"))
    e.join(F.broadcast(whole), "shard", "left_anti").write.mode("append").partitionBy("shard").json(path)  # a row a shard
    return done().join(whole.withColumn("resumed", F.lit(True)), "shard", "left").select("shard", "rows", F.coalesce("resumed", F.lit(False)).alias("resumed"))


@query("str5_batch_append", "SELECT event_id, event_id * 2 AS doubled FROM events")
def str5(spark: SparkSession, d: str) -> DataFrame:
    """Each micro-batch of a stream appends generated rows to a table."""
    source, out = _scratch(spark, "in"), _scratch(spark, "out")
    load(spark, d, "events").select("event_id").write.parquet(source)

    def grow(batch: DataFrame, _: int) -> None:
        batch.withColumn("doubled", F.col("event_id") * 2).write.mode("append").parquet(out)

    stream = spark.readStream.schema("event_id bigint").parquet(source)
    stream.writeStream.foreachBatch(grow).option("checkpointLocation", _scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("agg16_mean_of_present", "SELECT p_partkey, round(list_avg(list_filter([CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN 2 * p_size END, CASE WHEN p_size % 5 = 0 THEN 3 * p_size END], lambda x: x IS NOT NULL)), 7) AS mean FROM part")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    a = F.array_compact(F.array(*[F.when(s % k == 0, f * s) for f, k in ((1, 2), (2, 3), (3, 5))]))
    p = load(spark, d, "part").select("p_partkey", a.alias("a"))
    return p.select("p_partkey", F.round(F.when(F.size("a") > 0, F.aggregate("a", F.lit(0), lambda x, y: x + y) / F.size("a")), 7).alias("mean"))


_SCORES = "SELECT s_nationkey AS run, s_suppkey % 3 AS stage, " + ", ".join(f"round(avg(s_acctbal) FILTER (s_suppkey % 4 <> {k}) / 10000, 6) AS aime_{y}_avg8" for k, y in enumerate((2024, 2025, 2026))) + ", count(*) AS n FROM supplier GROUP BY ALL"


@query(
    "rcp8_result_summary",
    f"WITH s AS ({_SCORES}) SELECT run, stage, round(list_avg(list_filter([aime_2024_avg8, aime_2025_avg8, aime_2026_avg8], lambda x: x IS NOT NULL)), 7) AS aime_avg, n, CASE WHEN (run + stage) % 2 = 0 THEN n * 2 END AS truncated FROM s",
)
def rcp8(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of runs, a JSON file each in a tree, with the mean of the metrics that are there and the diagnostics beside them, if any.

    A run is a nation here, a stage a third of its suppliers.
    """
    k = F.col("s_suppkey") % 4
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("run"), (F.col("s_suppkey") % 3).alias("stage"))
    s = s.agg(*[F.round(F.avg(F.when(k != i, F.col("s_acctbal"))) / 10000, 6).alias(f"aime_{y}_avg8") for i, y in enumerate((2024, 2025, 2026))], F.count("*").alias("n"))
    root, beside = _scratch(spark, "outputs"), _scratch(spark, "diagnostics")
    names = [f"aime_{y}_avg8" for y in (2024, 2025, 2026)]
    s.select("run", "stage", F.to_json(F.struct(*names, "n")).alias("value")).repartition("run", "stage").write.partitionBy("run", "stage").text(root)
    s.filter((F.col("run") + F.col("stage")) % 2 == 0).select("run", "stage", F.to_json(F.struct((F.col("n") * 2).alias("truncated"))).alias("value")).write.partitionBy("run", "stage").text(beside)

    def tree(where: str, schema: str) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").schema(schema).json(where)
        path = F.col("_metadata.file_path")
        return read.select(F.regexp_extract(path, r"/run=(\d+)/", 1).cast("bigint").alias("run"), F.regexp_extract(path, r"/stage=(\d+)/", 1).cast("bigint").alias("stage"), "*")

    present = F.array_compact(F.array(*names))
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    summary = tree(root, ", ".join(f"{n} double" for n in names) + ", n bigint").select("run", "stage", F.round(mean, 7).alias("aime_avg"), "n")
    return summary.join(tree(beside, "truncated bigint"), ["run", "stage"], "left")


@query("agg19_reduce_by_name", "SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 7) AS value FROM (SELECT concat(event_type, CASE user_id % 3 WHEN 0 THEN '/max' WHEN 1 THEN '/min' ELSE '/loss' END) AS name, value FROM events) GROUP BY name")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 3
    e = load(spark, d, "events").select(F.concat("event_type", F.when(k == 0, "/max").when(k == 1, "/min").otherwise("/loss")).alias("name"), "value")
    v = F.when(F.contains("name", F.lit("max")), F.max("value")).when(F.contains("name", F.lit("min")), F.min("value")).otherwise(F.avg("value"))
    return e.groupBy("name").agg(F.round(v, 7).alias("value"))


@query("agg21_group_index", "SELECT row_id, dense_rank() OVER (ORDER BY source) - 1 AS g FROM source_rows WHERE source IS NOT NULL")
def agg21(spark: SparkSession, d: str) -> DataFrame:
    """Labels numbered in order: the labels are few and are numbered alone, then joined."""
    s = load(spark, d, "source_rows").filter("source is not null").select("row_id", "source")
    index = s.select("source").distinct().withColumn("g", F.dense_rank().over(Window.orderBy("source")) - 1)
    return s.join(index, "source").select("row_id", "g")


_BEST = "WITH p AS (SELECT c_mktsegment AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS at, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_acctbal IS NOT NULL), k AS (SELECT DISTINCT g, n FROM p), w AS (SELECT g, r, CAST('0x' || substr(sha256(concat_ws(':', 42, g, r, i)), 1, 15) AS BIGINT) % n AS at FROM k, range(1, 1001) a(r), range(1, 5) b(i)), x AS (SELECT g, r, max(v) AS best, min(v) AS worst, avg(v) AS mean FROM w JOIN p USING (g, at) GROUP BY g, r)"


@query("agg29_bootstrap", f"{_BEST.replace(' AS at', ' AS place').replace('(g, at)', '(g, place)')} SELECT g, " + ", ".join(f"round({f}({n}), 4) + 0.0 AS {n}_{k}" for n in ("best", "worst", "mean") for f, k in (("avg", "mean"), ("stddev_pop", "std"))) + " FROM x GROUP BY g")
def agg29(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations of best, worst and mean over 1,000 resamples of 4, drawn by hash from all values of a group."""
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), "c_custkey", "c_acctbal")
    x = sampling.resamples(c, "g", "c_acctbal", "c_custkey", 4, 1000, 42).groupBy("g", "resample").agg(F.max("c_acctbal").alias("best"), F.min("c_acctbal").alias("worst"), F.avg("c_acctbal").alias("mean"))
    return rounded(x.groupBy("g").agg(*[f(n).alias(f"{n}_{k}") for n in ("best", "worst", "mean") for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"))]), 4)


REQUIRED = {"recovery_pool": ["sample_id", "prompt", "domain"], "documents": ["doc_id", "text", "label"], "teacher_responses": ["response_id", "messages", "score", "teacher_response"]}
_NEEDED = " UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS c" for t, cs in REQUIRED.items() for c in cs)


@query("flt15_required_columns", f"SELECT name, count(*) FILTER (column_name IS NULL)::INTEGER AS missing, coalesce(string_agg(c, ',' ORDER BY c) FILTER (column_name IS NULL), '') AS names FROM ({_NEEDED}) n LEFT JOIN (SELECT DISTINCT table_name, column_name FROM duckdb_columns()) d ON d.table_name = n.name AND d.column_name = n.c GROUP BY name")
def flt15(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a table must have and does not."""
    rows = [(t, len(gone), ",".join(gone)) for t, cs in REQUIRED.items() if (gone := sorted(set(cs) - set(load(spark, d, t).columns))) is not None]
    return spark.createDataFrame(rows, "name string, missing int, names string")


_MASKS = "SELECT s_nationkey % 5 AS arm, s_suppkey AS ratio_id, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'minitron' WHEN 2 THEN CASE WHEN s_nationkey % 5 < 2 THEN 'minitron' ELSE 'wanda' END ELSE CASE WHEN s_nationkey % 5 = 0 THEN 'minitron' ELSE 'flap' END END AS pruning_method FROM supplier"


@query("flt21_mask_provenance", f"WITH m AS ({_MASKS}) SELECT arm, CASE WHEN arm = 4 THEN 'wanda' ELSE 'minitron' END AS expected, count(*) FILTER (coalesce(pruning_method, 'minitron') <> CASE WHEN arm = 4 THEN 'wanda' ELSE 'minitron' END) AS problems, count(*) FILTER (coalesce(pruning_method, 'minitron') <> CASE WHEN arm = 4 THEN 'wanda' ELSE 'minitron' END) = 0 AS passed FROM m GROUP BY arm")
def flt21(spark: SparkSession, d: str) -> DataFrame:
    """Was every mask built by the method that its arm declares? Masks without the field are of the first method."""
    arm, key = F.col("s_nationkey") % 5, F.col("s_suppkey") % 4
    found = F.when(key == 1, "minitron").when(key == 2, F.when(arm < 2, "minitron").otherwise("wanda")).when(key == 3, F.when(arm == 0, "minitron").otherwise("flap"))
    masks = load(spark, d, "supplier").select(arm.alias("arm"), found.alias("pruning_method"))
    return quality.mask_provenance(masks, F.when(F.col("arm") == 4, "wanda").otherwise("minitron"))


@query("flt23_increasing", "SELECT benchmark, coalesce(bool_and(ok), true) AS increasing FROM (SELECT benchmark, benchmark_index > lag(benchmark_index) OVER (PARTITION BY benchmark ORDER BY item_id) AS ok FROM benchmark_items) GROUP BY benchmark")
def flt23(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("benchmark").orderBy("item_id")
    b = load(spark, d, "benchmark_items").select("benchmark", (F.col("benchmark_index") > F.lag("benchmark_index").over(w)).alias("ok"))
    return b.groupBy("benchmark").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("increasing"))


_ONE = {
    "unique_row_ids": "SELECT count(*) FROM (SELECT row_id FROM source_rows GROUP BY row_id HAVING count(*) > 1)",
    "unique_sample_ids": "SELECT count(*) FROM (SELECT sample_id FROM recovery_pool WHERE sample_id IS NOT NULL GROUP BY sample_id HAVING count(*) > 1)",
    "domains_covered": "SELECT 4 - count(DISTINCT domain) FROM recovery_pool WHERE domain IN ('math', 'code', 'science', 'instruction_following')",
    "split_ids_disjoint": "SELECT count(*) FROM (SELECT sample_id FROM recovery_pool WHERE split = 'sft' INTERSECT SELECT sample_id FROM recovery_pool WHERE split = 'opd')",
    "split_prompts_disjoint": f"SELECT count(*) FROM (SELECT sha256({norm('prompt')}) AS h FROM recovery_pool WHERE split = 'sft' AND prompt IS NOT NULL INTERSECT SELECT sha256({norm('prompt')}) FROM recovery_pool WHERE split = 'opd' AND prompt IS NOT NULL)",
    "no_blank_prompts": "SELECT count(*) FROM recovery_pool WHERE split IN ('sft', 'opd') AND coalesce(trim(prompt), '') = ''",
    "columns_present": f"SELECT count(*) FILTER (column_name IS NULL) FROM ({_NEEDED}) n LEFT JOIN (SELECT DISTINCT table_name, column_name FROM duckdb_columns()) d ON d.table_name = n.name AND d.column_name = n.c",
    "mask_provenance": f"SELECT count(*) FROM ({_MASKS}) WHERE coalesce(pruning_method, 'minitron') <> CASE WHEN arm = 4 THEN 'wanda' ELSE 'minitron' END",
    "indices_increasing": "SELECT count(*) FROM (SELECT benchmark_index <= lag(benchmark_index) OVER (PARTITION BY benchmark ORDER BY item_id) AS bad FROM benchmark_items) WHERE bad",
    "plan_shares_sum_to_one": "SELECT count(*) FROM (SELECT plan_name FROM mix_targets GROUP BY plan_name HAVING abs(sum(target_share) - 1) > 1e-6)",
}


@query("rcp10_preflight", " UNION ALL ".join(f"SELECT '{n}' AS check_name, ({q})::BIGINT AS problems, ({q}) = 0 AS passed" for n, q in _ONE.items()))
def rcp10(spark: SparkSession, d: str) -> DataFrame:
    """Named gates, what each found, and its verdict."""
    s, p = load(spark, d, "source_rows"), load(spark, d, "recovery_pool")
    n = F.count("*").alias("problems")
    hashes = p.filter("prompt is not null").select("split", text.prompt_hash(F.col("prompt")).alias("h"))
    w = Window.partitionBy("benchmark").orderBy("item_id")
    gates = {
        "unique_row_ids": s.groupBy("row_id").count().filter("count > 1").agg(n),
        "unique_sample_ids": p.filter("sample_id is not null").groupBy("sample_id").count().filter("count > 1").agg(n),
        "domains_covered": p.filter(F.col("domain").isin("math", "code", "science", "instruction_following")).agg((4 - F.countDistinct("domain")).alias("problems")),
        "split_ids_disjoint": set9(spark, d).withColumnRenamed("shared", "problems"),
        "split_prompts_disjoint": hashes.filter("split = 'sft'").select("h").intersect(hashes.filter("split = 'opd'").select("h")).agg(n),
        "no_blank_prompts": p.filter(F.col("split").isin("sft", "opd") & (F.coalesce(F.trim("prompt"), F.lit("")) == "")).agg(n),
        "columns_present": flt15(spark, d).agg(F.sum("missing").alias("problems")),
        "mask_provenance": flt21(spark, d).agg(F.sum("problems").alias("problems")),
        "indices_increasing": load(spark, d, "benchmark_items").select((F.col("benchmark_index") <= F.lag("benchmark_index").over(w)).alias("bad")).filter("bad").agg(n),
        "plan_shares_sum_to_one": load(spark, d, "mix_targets").groupBy("plan_name").agg(F.sum("target_share").alias("t")).filter("abs(t - 1) > 1e-6").agg(n),
    }
    out = None
    for name, g in gates.items():
        row = g.select(F.lit(name).alias("check_name"), F.coalesce("problems", F.lit(0)).cast("bigint").alias("problems"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.col("problems") == 0)


@query("rcp9_trajectory_table", "SELECT DISTINCT sample_id, reward_model.style AS reward_model__style, extra_info.original_id AS extra_info__original_id FROM recovery_pool WHERE split = 'opd'")
def rcp9(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "recovery_pool").filter("split = 'opd'").select("sample_id", F.struct(F.col("reward_model.style").alias("style")).alias("reward_model"), "extra_info")
    return files.flatten(p, "__").distinct()


@query("res3_metric_routing", "SELECT name, CASE WHEN name LIKE '%acc/mean@%' OR name LIKE '%acc/best@%' THEN 'core' ELSE 'aux' END AS route FROM (SELECT DISTINCT concat('val/', event_type, '/', CASE WHEN user_id % 2 = 0 THEN 'acc' ELSE 'reward' END, CASE WHEN user_id % 3 = 0 THEN '/mean@8' ELSE '/std@8' END) AS name FROM events)")
def res3(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    name = F.concat(F.lit("val/"), "event_type", F.lit("/"), F.when(u % 2 == 0, "acc").otherwise("reward"), F.when(u % 3 == 0, "/mean@8").otherwise("/std@8"))
    return load(spark, d, "events").select(name.alias("name")).distinct().withColumn("route", F.when(F.col("name").rlike("acc/(mean|best)@"), "core").otherwise("aux"))


@query("res4_generation_batch", "SELECT DISTINCT sample_id, data_source FROM recovery_pool")
def res4(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").drop("prompt", "reward_model", "extra_info").select("sample_id", "data_source").distinct()


@query("res6_uid_repeat", "SELECT sha256(item_id::VARCHAR) AS uid, r AS copy FROM benchmark_items, range(4) t(r)")
def res6(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "benchmark_items").select(F.col("item_id").alias("ord"), F.sha2(F.col("item_id").cast("string"), 256).alias("uid"))
    return batches.repeat_rows(rows, 4).select("uid", F.col("copy").cast("bigint").alias("copy"))


@query("res7_passages", "SELECT benchmark, string_agg(concat('Doc ', i, ' (Title: ', split_part(text, '.', 1), ') ', substr(text, length(split_part(text, '.', 1)) + 2)), chr(10) ORDER BY i) AS passages FROM (SELECT benchmark, text, row_number() OVER (PARTITION BY benchmark ORDER BY benchmark_index, item_id) AS i FROM benchmark_items) WHERE i <= 3 GROUP BY benchmark")
def res7(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of a search as one text: number, title and what follows it."""
    w = Window.partitionBy("benchmark").orderBy("benchmark_index", "item_id")
    hits = load(spark, d, "benchmark_items").withColumn("i", F.row_number().over(w)).filter("i <= 3")
    title = F.substring_index("text", ".", 1)
    line = F.concat(F.lit("Doc "), F.col("i").cast("string"), F.lit(" (Title: "), title, F.lit(") "), F.substring("text", F.length(title) + 2, F.length("text")))
    g = hits.groupBy("benchmark").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("h"))
    return g.select("benchmark", F.array_join(F.transform("h", lambda x: x["line"]), "\n").alias("passages"))


@query("res8_generation_table", "SELECT o_custkey AS prompt, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS responses FROM orders GROUP BY o_custkey")
def res8(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col("o_custkey").alias("prompt")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("responses"))


@query("sca24_integral_floats", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity FROM lineitem")
def sca24(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(q == F.floor(q), q.cast("bigint").cast("string")).otherwise(q.cast("string")).alias("quantity"))


@query("sca28_thinking_flag", "SELECT DISTINCT sample_id, coalesce(enable_thinking, split = 'opd') AS thinking FROM recovery_pool")
def sca28(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").select("sample_id", F.coalesce("enable_thinking", F.col("split") == "opd").alias("thinking")).distinct()


@query("sca36_method_description", "SELECT plan_name, target_id, format('{} of {} at {:.2f}', plan_name, split, target_share) AS description FROM mix_targets")
def sca36(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "mix_targets").select("plan_name", "target_id", F.format_string("%s of %s at %.2f", "plan_name", "split", "target_share").alias("description"))


@query("sca37_expected_steps", "SELECT split, batch, least((count(*) // batch) * 2, 12) AS steps, (count(*) // batch) * 2 > 12 AS cut FROM recovery_pool, (VALUES (32), (64), (100)) b(batch) GROUP BY split, batch")
def sca37(spark: SparkSession, d: str) -> DataFrame:
    """Optimizer steps of two epochs by batch size, within a budget of twelve."""
    n = load(spark, d, "recovery_pool").groupBy("split").agg(F.count("*").alias("n")).withColumn("batch", F.explode(F.array(F.lit(32), F.lit(64), F.lit(100))))
    steps = F.floor(F.col("n") / F.col("batch")) * 2
    return n.select("split", "batch", F.least(steps, F.lit(12)).alias("steps"), (steps > 12).alias("cut"))
