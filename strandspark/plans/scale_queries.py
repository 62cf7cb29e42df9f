"""Queries of operators for reads of any length and joins by place, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandspark import session
from strandspark.functions import expand
from strandspark.operators import chain, intervals, scan, sequence, sketches, sums
from strandspark.plans.driver_queries import _CHAINS, _MOVED, _RUNS, _calls, _each, _each_sql, _fold_sql, _path_sql, _posterior_sql, _sql, r, register, rs
from strandspark.plans.views import RUN, SIGNAL, block_sql, table, v_block, v_path, v_run, v_signal
from strandspark.sources import files, records
from strandspark.sources import text as text_format
from strandspark.streaming import windows
from strandspark.streaming.reads import stream_partitions

# ---------------------------------------------------------------- one very long read

# all vectors, in the order of their ids, are the blocks of one read; ranges are short so that the tree has levels
_SIZE, _FAN = 24, 4


def _long_read(spark, d, width: int):
    """Ids of vectors count without gaps and number the blocks."""
    vectors = table(spark, d, "embeddings")
    first = vectors.agg(F.min("vec_id")).first()[0]
    weights = F.transform(F.slice("embedding", 1, width), lambda x: x.cast("double") * 2.0)
    return vectors.select(F.lit(0).cast("long").alias("read_id"), (F.col("vec_id") - F.lit(first)).alias("blk"), weights.alias("w"))


def _long_sql(width: int) -> str:
    return f"(SELECT 0::BIGINT AS read_id, vec_id - (SELECT min(vec_id) FROM embeddings) AS blk, list_transform(embedding[1:{width}], lambda x: x::DOUBLE * 2.0) AS w FROM embeddings)"


_FF, _RL = _CHAINS["flip_flop"], _CHAINS["run_length"]


def _z_sql(t: chain.Topology) -> str:
    z = " + ".join(f"exp(s[{k + 1}] - list_max(s))" for k in range(t.n_state))
    return f"WITH RECURSIVE {_fold_sql(t, True, _long_sql(t.n_weight))} SELECT read_id, {rs(f'list_max(s) + ln({z})', 4)} AS log_z FROM z"


@register(_z_sql(_FF))
def long_read_partition(spark, d):
    return scan.partition_by_ranges(_long_read(spark, d, _FF.n_weight), _FF, _SIZE, _FAN).select("read_id", r(F.col("log_z"), 4).alias("log_z"))


@register(_z_sql(_RL))
def long_read_run_partition(spark, d):
    return scan.partition_by_ranges(_long_read(spark, d, _RL.n_weight), _RL, _SIZE, _FAN).select("read_id", r(F.col("log_z"), 4).alias("log_z"))


@register(f"WITH RECURSIVE {_fold_sql(_FF, False, _long_sql(_FF.n_weight))} SELECT read_id, {rs('list_max(s)', 4)} AS score FROM z")
def long_read_score(spark, d):
    return scan.score_by_ranges(_long_read(spark, d, _FF.n_weight), _FF, _SIZE, _FAN).select("read_id", r(F.col("score"), 4).alias("score"))


@register(_path_sql(_FF, _long_sql(_FF.n_weight)))
def long_read_path(spark, d):
    found = scan.decode_by_ranges(_long_read(spark, d, _FF.n_weight), _FF, _SIZE, _FAN)
    return found.select("read_id", "pos", "state", r(F.col("q"), 5).alias("q"), r(F.col("score"), 4).alias("score"))


@register(f"WITH RECURSIVE {_posterior_sql(_FF, _long_sql(_FF.n_weight))} {_each_sql('w', 'p', 4)}")
def long_read_posterior(spark, d):
    return _each(scan.posteriors_by_ranges(_long_read(spark, d, _FF.n_weight), _FF, size=_SIZE, fan=_FAN), F.col("w"), 4)


# ---------------------------------------------------------------- joins by place

_STRIDE = 5
_SPANS = f"""(SELECT read_id, run_idx, base, ("end" - dwell * {_STRIDE})::BIGINT AS start, "end"::BIGINT AS "end" FROM
    (SELECT *, 2 + {_STRIDE} * sum(dwell) OVER (PARTITION BY read_id ORDER BY run_idx) AS "end" FROM {_RUNS}))"""


@register(f"""SELECT b.read_id, b.run_idx, b.base, b.start, b."end", s.idx, {rs('s.value')} AS value FROM {_SPANS} b JOIN {SIGNAL} s ON s.read_id = b.read_id AND s.idx BETWEEN b.start AND b."end" - 1""")
def run_samples(spark, d):
    """Which samples each run was called from."""
    runs = intervals.run_spans(sequence.emit_runs(v_path(spark, d), 4), _STRIDE, 2).select("read_id", "run_idx", "base", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    samples = v_signal(spark, d).withColumn("next", F.col("idx") + 1)
    found = intervals.overlap_join(runs, samples, ["read_id"], ("start", "end"), ("idx", "next"))
    return found.select("read_id", "run_idx", "base", "start", "end", "idx", r(F.col("value")).alias("value"))


_STRETCH = f"""(SELECT read_id, pos, state, 3 * pos AS start, 3 * coalesce(lead(pos) OVER (PARTITION BY read_id ORDER BY pos), last + 1) AS "end" FROM {_MOVED} WHERE before IS NULL OR state <> before)"""


@register(f"""SELECT a.read_id, a.pos, a.state, b.run_idx, greatest(a.start, b.start) AS low, least(a."end", b."end") AS high FROM {_STRETCH} a JOIN {_SPANS} b ON a.read_id = b.read_id AND a.start < b."end" AND b.start < a."end" """)
def base_run_overlaps(spark, d):
    """Stretches of one state against runs of another stride: which samples both claim."""
    bases = intervals.base_spans(v_path(spark, d), 3)
    runs = intervals.run_spans(sequence.emit_runs(v_path(spark, d), 4), _STRIDE, 2).select("read_id", "run_idx", F.col("start").alias("run_start"), F.col("end").alias("run_end"))
    found = intervals.overlap_join(bases, runs, ["read_id"], ("start", "end"), ("run_start", "run_end"))
    return found.select("read_id", "pos", "state", "run_idx", F.greatest("start", "run_start").alias("low"), F.least("end", "run_end").alias("high"))


@register(f"SELECT s.read_id, s.idx, {rs('s.value')} AS value, c.pos AS changed_at, c.state FROM {SIGNAL} s ASOF LEFT JOIN (SELECT read_id, pos, state FROM {_MOVED} WHERE state <> before AND pos % 3 = 0) c ON s.read_id = c.read_id AND s.idx >= c.pos")
def asof_changes(spark, d):
    """Each sample with the latest change of state at or before it."""
    changes = sequence.change_positions(v_path(spark, d)).where("pos % 3 = 0").select("read_id", F.col("pos").alias("idx"), "state")
    found = intervals.asof_join(v_signal(spark, d), changes, ["read_id"], "idx", bin_width=16)
    return found.select("read_id", "idx", r(F.col("value")).alias("value"), F.col("matched_at").alias("changed_at"), "state")


_ASOF_TIME = """SELECT e.event_id, e.user_id, v.event_id AS view_id, {gap} AS seconds FROM (SELECT * FROM events WHERE event_type = 'error') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts"""


@register(
    f"""SELECT event_id, user_id, CASE WHEN seconds <= 86400 THEN view_id END AS view_id, CASE WHEN seconds <= 86400 THEN seconds END AS seconds
    FROM ({_ASOF_TIME.format(gap='(epoch_us(e.ts) - epoch_us(v.ts)) // 1000000')})"""
)
def asof_events(spark, d):
    """Each error with its user's last view, if that is no more than a day old."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    found = intervals.asof_join(events.where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp")), views.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", 86_401.0, 86_400.0)
    seconds = F.expr("(unix_micros(ts) - unix_micros(matched_at)) div 1000000")
    near = seconds <= 86_400
    return found.select("event_id", "user_id", F.when(near, F.col("view_id")).alias("view_id"), F.when(near, seconds).alias("seconds"))


# ---------------------------------------------------------------- mergeable quantiles and sums

_CHUNK = 16
_PS = (0.05, 0.25, 0.5, 0.75, 0.95)


def _levels_sql() -> str:
    ps = ", ".join(map(str, _PS))
    return f"""SELECT level, key, p, n, true AS within FROM (
        SELECT 'chunk' AS level, read_id || ':' || (idx // {_CHUNK}) AS key, count(*) AS n FROM {SIGNAL} GROUP BY ALL
        UNION ALL SELECT 'read', read_id, count(*) FROM {SIGNAL} GROUP BY ALL
        UNION ALL SELECT 'all', NULL, count(*) FROM {SIGNAL}), (SELECT unnest([{ps}])::DOUBLE AS p)"""


@register(_levels_sql())
def sketch_quantiles(spark, d):
    """Quantiles of chunks, reads and the table from sketches of chunks: is their rank among all samples near enough?"""
    samples = v_signal(spark, d).select("read_id", F.floor(F.col("idx") / _CHUNK).alias("chunk"), "value")
    chunks = sketches.sketch(samples, ["read_id", "chunk"])
    reads = sketches.merge(chunks, ["read_id"])
    whole = sketches.merge(reads, [])
    name = F.concat_ws(":", "read_id", F.col("chunk").cast("string"))
    level = lambda s, kind, key: s.select(F.lit(kind).alias("level"), key.alias("key"), "sketch", "n")
    held = level(chunks, "chunk", name).unionByName(level(reads, "read", F.col("read_id"))).unionByName(level(whole, "all", F.lit(None).cast("string")))
    asked = held.select("level", "key", "n", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), sketches.quantile(p).alias("q")) for p in _PS])))
    told = lambda kind, key: samples.select(F.lit(kind).alias("of"), key.alias("of_key"), "value")
    truth = told("chunk", name).unionByName(told("read", F.col("read_id"))).unionByName(told("all", F.lit(None).cast("string")))
    same = (F.col("level") == F.col("of")) & F.col("key").eqNullSafe(F.col("of_key"))
    ranks = truth.join(asked, same).groupBy("level", "key", "p", "n").agg(F.avg((F.col("value") < F.col("q")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("int")).alias("up_to"))
    off = F.greatest(F.lit(0.0), F.col("below") - F.col("p"), F.col("p") - F.col("up_to"))
    return ranks.select("level", "key", "p", "n", (off <= 3 * sketches.rank_error()).alias("within"))


@register(f"SELECT read_id, true AS median_near, true AS mad_near FROM {SIGNAL} GROUP BY read_id")
def sketch_mad(spark, d):
    """Median and MAD of reads by two sketches against exact order statistics two ranks around."""
    samples = v_signal(spark, d)
    found = sketches.sketched_mad(samples, ["read_id"])
    apart = samples.join(found, "read_id").withColumn("apart", sketches.MAD_SCALE * F.abs(F.col("value") - F.col("median")))
    low = lambda x, y: F.avg((F.col(x) < F.col(y)).cast("int"))
    high = lambda x, y: F.avg((F.col(x) <= F.col(y) + 1e-9).cast("int"))
    e = 3 * sketches.rank_error()
    near = lambda x, y: (low(x, y) - e <= 0.5) & (high(x, y) + e >= 0.5)
    return apart.groupBy("read_id").agg(near("value", "median").alias("median_near"), near("apart", "mad").alias("mad_near"))


@register(f"SELECT read_id, round(fsum(value), 9) + 0.0 AS total, count(*) AS n, true AS same FROM {SIGNAL} GROUP BY read_id")
def exact_sums(spark, d):
    """Sums of reads, the same to the last bit however the samples are dealt out: as they come, and each read's over all partitions."""
    samples = v_signal(spark, d)
    one, other = (sums.exact_sums(dealt, ["read_id"], "value") for dealt in (samples, samples.repartition("idx", "read_id")))
    other = other.select("read_id", F.col("total").alias("again"))
    return one.join(other, "read_id").select("read_id", r(F.col("total"), 9).alias("total"), "n", (F.col("total") == F.col("again")).alias("same"))


@register(f"SELECT read_id, idx, {rs('(value - avg(value) OVER (PARTITION BY read_id)) / stddev_pop(value) OVER (PARTITION BY read_id)')} AS value FROM {SIGNAL}")
def studentise_exact(spark, d):
    return sums.studentise_exact(v_signal(spark, d)).select("read_id", "idx", r(F.col("value")).alias("value"))


# ---------------------------------------------------------------- streams


def _stream(spark, label: str, batches: list, plan):
    """Tables as the batches of a stream, one file and batch each, in order; what the stream has written when all are read."""
    source, place = session.scratch_path(spark, label), session.scratch_path(spark, f"{label}-out")
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{source}/batch={k:04d}")
    arriving = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    planned = plan(arriving)
    query = planned.writeStream.format("parquet").option("path", place).option("checkpointLocation", f"{place}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(planned.schema).parquet(place)


def _partition_rows(t: chain.Topology) -> str:
    z = " + ".join(f"exp(s[{k + 1}] - list_max(s))" for k in range(t.n_state))
    return f"WITH RECURSIVE {_fold_sql(t, True)} SELECT read_id, {rs(f'list_max(s) + ln({z})', 4)} AS log_z FROM z"


@register(_partition_rows(_FF))
def streamed_partitions(spark, d):
    """Blocks dealt to three batches by hash; every read's forward sums are carried from batch to batch."""
    blocks = v_block(spark, d, _FF.n_weight, 2.0)
    blocks = blocks.withColumn("last", F.col("blk") == F.max("blk").over(Window.partitionBy("read_id"))).withColumn("part", F.pmod(F.xxhash64("read_id", "blk"), F.lit(3)))
    batches = [blocks.where(F.col("part") == k).drop("part") for k in range(3)]
    return _stream(spark, "blocks", batches, lambda s: stream_partitions(s, _FF)).select("read_id", r(F.col("log_z"), 4).alias("log_z"))


# three batches in the order of time, then late rows from all of it, one in forty
_GAP_S, _DELAY_S = 14_400, 3_600
_PARTED = """SELECT *, CASE WHEN event_id % 40 = 7 THEN 3 ELSE least(2, 3 * (epoch_us(ts) - lo) // greatest(1, hi - lo)) END AS batch
    FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)"""


def _arriving(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    micros = F.unix_micros("ts")
    lo, hi = events.agg(F.min(micros), F.max(micros)).first()
    batch = F.when(F.col("event_id") % 40 == 7, 3).otherwise(F.least(F.lit(2), F.floor(3 * (micros - F.lit(lo)) / F.lit(max(1, hi - lo)))))
    return [events.where(batch == k) for k in range(4)]


_LATE = f"""WITH e AS ({_PARTED}),
    w AS (SELECT max(epoch_us(ts)) - {_DELAY_S}000000 AS late FROM e WHERE batch < 2), f AS (SELECT max(epoch_us(ts)) - {_DELAY_S}000000 AS done FROM e)"""


def _session_sql(rows: str, name: str) -> str:
    """Rows of each key numbered by sessions: a gap begins one."""
    return f"""{name} AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM (
        SELECT *, CASE WHEN t >= {_GAP_S}000000 + lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 1 ELSE 0 END AS fresh FROM ({rows})))"""


_SESSIONS = f"""{_LATE}, {_session_sql('SELECT user_id, event_id, value, epoch_us(ts) AS t FROM e WHERE batch < 3', 'a')},
    b AS (SELECT *, max(t) OVER (PARTITION BY user_id, session) + {_GAP_S}000000 <= late AS closed FROM a, w),
    {_session_sql(f'SELECT user_id, event_id, value, t FROM b WHERE NOT closed UNION ALL SELECT user_id, event_id, value, epoch_us(ts) FROM e, w WHERE batch = 3 AND epoch_us(ts) + {_GAP_S}000000 > late', 'c')},
    g AS (SELECT user_id, t, value, 'early' || session AS part FROM b WHERE closed UNION ALL SELECT user_id, t, value, 'late' || session FROM c)
    SELECT user_id, min(t) AS start, max(t) + {_GAP_S}000000 AS "end", count(*) AS n, {rs('sum(value)', 4)} AS total, max(value) AS largest
    FROM g, f GROUP BY user_id, part, done HAVING max(t) + {_GAP_S}000000 <= done"""


@register(_SESSIONS)
def session_windows(spark, d):
    """Sessions of users from a stream in which one row in forty comes late: those behind the watermark are dropped."""
    found = _stream(spark, "sessions", _arriving(spark, d), lambda s: windows.sessions(s, "user_id", f"{_GAP_S} seconds", f"{_DELAY_S} seconds"))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", r(F.col("total"), 4).alias("total"), "largest")


_WIDTH_S = 86_400


@register(
    f"""{_LATE}, x AS (SELECT event_type, epoch_us(ts) // {_WIDTH_S}000000 * {_WIDTH_S}000000 AS start, value FROM e, w WHERE batch < 3 OR (epoch_us(ts) // {_WIDTH_S}000000 + 1) * {_WIDTH_S}000000 > late),
    m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY event_type, start) AS median FROM x)
    SELECT event_type, start, count(*) AS n, {rs('any_value(median)')} AS median, {rs('1.4826 * quantile_cont(abs(value - median), 0.5)')} AS mad FROM m, f WHERE start + {_WIDTH_S}000000 <= done GROUP BY event_type, start"""
)
def tumbling_mads(spark, d):
    """Median and MAD of each kind of event by day, from the same stream."""
    found = _stream(spark, "tumbling", _arriving(spark, d), lambda s: windows.tumbling_mad(s, "event_type", f"{_WIDTH_S} seconds", f"{_DELAY_S} seconds"))
    return found.select("event_type", F.unix_micros("start").alias("start"), "n", r(F.col("median")).alias("median"), r(F.col("mad")).alias("mad"))


# ---------------------------------------------------------------- files


def _fastq_parts(name: str, f):
    """(read_id, record) of a FASTQ file's fours of lines."""
    lines = f.read().decode().split("\n")
    for k in range(0, len(lines) - 3, 4):
        yield lines[k].split('"uuid" : "')[1].split('"')[0], "\n".join(lines[k : k + 4])


@register(_sql["fastq_records"])
def written_fastq(spark, d):
    """FASTQ records written under a commit, found by Spark's listing and parsed file by file."""
    records.register(spark)
    place = session.scratch_path(spark, "fastq")
    made = text_format.format_calls(_calls(spark, d), "fastq").select("record").repartition(F.xxhash64("record"))
    made.write.format("strand_records").option("ending", "fastq").option("exclusive", "true").mode("append").save(place)
    return files.read_files(spark, place, _fastq_parts, "read_id string, record string", "*.fastq", large=1 << 14).where("error is null").select("read_id", "record")


def _run_folder(spark, d) -> str:
    """Run records of two appending jobs."""
    records.register(spark)
    place = session.scratch_path(spark, "runs")
    made = text_format.run_records(v_run(spark, d))
    for part in (F.col("read_id") < "5", F.col("read_id") >= "5"):
        made.where(part).select("record").write.format("strand_records").option("ending", "run").mode("append").save(place)
    return place


def _runs_back(read):
    return read.select("read_id", "run_idx", "base", r(F.col("shape")).alias("shape"), r(F.col("scale")).alias("scale"), "dwell")


@register(_sql["run_file"])
def written_runs(spark, d):
    """Run records written under commits and read by byte ranges."""
    return _runs_back(spark.read.format("strand_runs").option("split_bytes", 4096).load(_run_folder(spark, d)))


@register(_sql["run_file"])
def streamed_runs(spark, d):
    """The same folder as a stream of run records."""
    place = _run_folder(spark, d)
    out = session.scratch_path(spark, "runs-out")
    stream = spark.readStream.format("strand_runs").option("split_bytes", 16_384).load(place)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _runs_back(spark.read.schema(stream.schema).parquet(out))


def _matrix_size(name: str, f):
    """(nr, nc, total) of a matrix file whose values are as many as its first line says."""
    first, _, rest = f.read().decode().partition("\n")
    nr, nc = map(int, first.split())
    data = [float.fromhex(x) for x in rest.split()]
    if len(data) != nr * nc:
        raise ValueError(f"{len(data)} values instead of {nr * nc}")
    yield nr, nc, math.fsum(data)


@register(
    f"""SELECT read_id, CASE WHEN read_id % 3 <> 1 THEN 64 END AS nr, CASE WHEN read_id % 3 <> 1 THEN count(*)::INT END AS nc, CASE WHEN read_id % 3 <> 1 THEN {rs('sum(list_sum(w))')} END AS total,
    CASE WHEN read_id % 3 = 1 THEN 'ValueError: ' || (64 * count(*) - 1) || ' values instead of ' || 64 * count(*) END AS error FROM {block_sql(64)} GROUP BY read_id"""
)
def parsed_files(spark, d):
    """Matrix files, every third cut short, parsed in tasks: a bad one is a row with its error."""
    columns = F.transform(F.array_sort(F.collect_list(F.struct("blk", "w"))), lambda p: p["w"])
    made = v_block(spark, d, 64).groupBy("read_id").agg(columns.alias("data"))
    rows = made.select(F.col("read_id").cast("string").alias("name"), F.lit(64).alias("nr"), F.size("data").alias("nc"), "data")
    cut = F.when(F.col("name").cast("long") % 3 == 1, F.regexp_replace("record", r"\s\S+\s*$", "")).otherwise(F.col("record"))
    place = session.scratch_path(spark, "matrices")
    text_format.matrix_records(rows).select("name", cut.alias("record")).write.partitionBy("name").option("lineSep", "\n").text(place)
    # a folder each; the file's folder names the read
    found = files.read_files(spark, place, _matrix_size, "nr int, nc int, total double", "*.txt", below=True)
    read_id = F.regexp_extract("path", "name=([0-9]+)", 1).cast("long").alias("read_id")
    return found.select(read_id, "nr", "nc", r(F.col("total")).alias("total"), "error")


@register(
    f"""SELECT read_id, (before + k)::BIGINT AS pos, run_idx::INT AS run_idx, base FROM (
        SELECT *, sum(n) OVER (PARTITION BY read_id ORDER BY run_idx) - n AS before, unnest(range(n)) AS k
        FROM (SELECT *, greatest(1, floor(scale * 1.04))::BIGINT AS n FROM {RUN}))"""
)
def expanded_runs(spark, d):
    """Each base that a run stands for and its place in the read, by a table function."""
    return expand.expanded(v_run(spark, d).select("read_id", F.col("run_idx").cast("int").alias("run_idx"), "base", "scale"), 1.04)
