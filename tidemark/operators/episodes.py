"""Episodes: gap-tolerant stitching, relations between two sides, metrics, scorecards; and ordered sequences."""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.temporal import saturating_subtract

GROUP = ["window_name", "key", "source", "partition_id"]
COMPATIBLE = ["window_name", "key", "partition_id"]


def normalise(windows: DataFrame, horizon: int | None = None) -> DataFrame:
    """Fragments: closed windows, and with a horizon those begun by it, open ones clipped."""
    w = windows if horizon is not None else windows.where("end_position is not null")
    end = F.col("end_position") if horizon is None else F.coalesce("end_position", F.lit(horizon).cast("long"))
    return w.select(*GROUP, "record_id", F.col("start_position").alias("s"), end.alias("e"), F.col("end_position").isNull().alias("prov")).where("e >= s")


def _islands(df: DataFrame, by: list[str], tolerance: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("s", "e", "record_id")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(F.col("s") - reach <= tolerance, 0).otherwise(1)).withColumn(name, F.sum("_new").over(w)).drop("_new")


def fragments(windows: DataFrame, tolerance: int, horizon: int | None = None) -> DataFrame:
    """Fragments with `episode_id`: the group and the first fragment's start and id."""
    f = _islands(normalise(windows, horizon), GROUP, tolerance, "ep")
    w = Window.partitionBy(*GROUP, "ep").orderBy("s", "e", "record_id")
    return f.withColumn("episode_id", F.concat(F.lit("e:"), F.first("record_id").over(w))).drop("ep")


def union_length(df: DataFrame, by: list[str]) -> DataFrame:
    """by, active: the length of the union of ranges."""
    isl = _islands(df, by, 0, "isl").groupBy(*by, "isl").agg((F.max("e") - F.min("s")).alias("len"))
    return isl.groupBy(*by).agg(F.sum("len").alias("active"))


def form(windows: DataFrame, tolerance: int, horizon: int | None = None) -> DataFrame:
    """One row an episode; `identity` is a SHA-256 over all its fragments. Provisional: a provisional fragment, or a horizon that has not passed the settling boundary."""
    f = fragments(windows, tolerance, horizon)
    by = [*GROUP, "episode_id"]
    e = f.groupBy(*by).agg(F.min("s").alias("start_m"), F.max("e").alias("end_m"), F.count(F.lit(1)).alias("fragments"), F.bool_or("prov").alias("p"), F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "record_id"))), lambda x: F.concat_ws(" ", x["s"], x["e"], x["record_id"]))), 256).alias("identity"))
    a = union_length(f, ["episode_id"])
    late = F.lit(False) if horizon is None else F.lit(horizon) <= F.col("end_m") + tolerance
    return e.join(a, "episode_id").select(*by, "start_m", "end_m", "fragments", (F.col("end_m") - F.col("start_m")).alias("elapsed"), "active", (F.col("end_m") - F.col("start_m") - F.col("active")).alias("internal_gap"), F.when(F.col("p") | late, "Provisional").otherwise("Final").alias("finality"), "identity")


def distribution(column: str, prefix: str) -> list:
    return [F.min(column).alias(f"{prefix}_min"), F.avg(column).alias(f"{prefix}_mean"), F.percentile(column, 0.5).alias(f"{prefix}_median"), F.expr(f"percentile_disc(0.95) within group (order by {column})").cast("long").alias(f"{prefix}_p95"), F.max(column).alias(f"{prefix}_max")]


def set_summary(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count(F.lit(1)).alias("episodes"), F.sum("fragments").alias("fragments"), F.avg((F.col("fragments") > 1).cast("int")).alias("multi_fragment_rate"), F.max("fragments").alias("max_fragments"), F.sum("elapsed").alias("total_elapsed"), F.sum("active").alias("total_active"), *distribution("elapsed", "elapsed"), *distribution("active", "active"))


def relations(windows: DataFrame, target: str, against: str, stitch: int, tolerance: int, horizon: int | None = None) -> DataFrame:
    """Members of relation components: side, episode_id, component (its least episode), kind, finality. An edge joins episodes
    of one (window, key, partition) of which two fragments are within the tolerance; a component never leaves that group, so
    components are found group by group.

    Fragments meet in time bins as wide as a group's fragments lie apart on average, or as the tolerance: fragments of one
    source are disjoint, so a group has about two bins a fragment, and no fragment meets those far from it. Null and empty
    partitions are different ones. A relation is Provisional with any provisional episode, or while the horizon has not
    passed its last end by more than the tolerance."""
    f = fragments(windows.where(F.col("source").isin(target, against)), stitch, horizon).withColumn("side", F.when(F.col("source") == target, "T").otherwise("A"))
    both = f.select(F.to_json(F.struct(*COMPATIBLE), {"ignoreNullFields": "false"}).alias("grp"), "side", "episode_id", "s", "e", "prov")
    over = Window.partitionBy("grp")
    mean = F.ceil((F.max("e").over(over) - F.min("s").over(over)) / F.count(F.lit(1)).over(over))
    dealt = both.withColumn("width", F.greatest(F.lit(1), F.lit(tolerance), mean).cast("long"))
    early = F.when(F.col("side") == "T", F.lit(tolerance)).otherwise(0)
    dealt = dealt.withColumn("bin", F.explode(F.sequence(F.floor((F.col("s") - early) / F.col("width")), F.floor((F.col("e") + early) / F.col("width")))))
    tt, aa = (dealt.where(F.col("side") == x).select("grp", "bin", *[F.col(c).alias(f"{x.lower()}_{n}") for c, n in (("episode_id", "id"), ("s", "s"), ("e", "e"))]) for x in "TA")
    edges = tt.join(aa, ["grp", "bin"]).where((F.col("t_s") <= F.col("a_e") + tolerance) & (F.col("a_s") <= F.col("t_e") + tolerance)).select("grp", "t_id", "a_id").distinct()

    def union_find(pairs) -> list[tuple]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in pairs:
            i, j = find(("T", i)), find(("A", j))
            if i != j:
                root[max(i, j)] = min(i, j)
        return [(x[0], x[1], "|".join(find(x))) for x in list(root)]

    def run(batches):
        """Groups arrive whole and one after another."""
        group, held, out = None, [], []
        for b in batches:
            for k, i, j in zip(*(c.to_pylist() for c in b.columns)):
                if k != group:
                    out += union_find(held)
                    group, held = k, []
                held.append((i, j))
            yield pack(out)
            out = []
        yield pack(out + union_find(held))

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["s", "episode_id", "component"])

    comp = edges.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "s string, episode_id string, component string")
    sizes = comp.groupBy("component").agg(F.count_if(F.col("s") == "T").alias("tn"), F.count_if(F.col("s") == "A").alias("an"))
    kind = F.when((F.col("tn") == 1) & (F.col("an") == 1), "OneToOne").when(F.col("tn") == 1, "Split").when(F.col("an") == 1, "Merge").otherwise("Complex")
    linked = comp.join(sizes, "component").select("s", "episode_id", "component", kind.alias("kind"))
    late = F.lit(False) if horizon is None else F.lit(horizon) <= F.max("e") + stitch
    ep = both.groupBy(F.col("side").alias("s"), "episode_id").agg((F.bool_or("prov") | late).alias("prov"), F.max("e").alias("end"))
    out = ep.join(linked, ["s", "episode_id"], "left").withColumn("component", F.coalesce("component", F.concat_ws("|", "s", "episode_id")))
    over = Window.partitionBy("component")
    open_ = F.max("prov").over(over) if horizon is None else F.max("prov").over(over) | (F.lit(horizon) <= F.max("end").over(over) + tolerance)
    final = F.when(open_, "Provisional").otherwise("Final").alias("finality")
    return out.select(F.when(F.col("s") == "T", "Target").otherwise("Against").alias("side"), "episode_id", "component", F.coalesce("kind", F.when(F.col("s") == "T", "UnmatchedTarget").otherwise("UnmatchedAgainst")).alias("kind"), final)


def of_kind(relations_: DataFrame, kind: str) -> DataFrame:
    """Members of the relations of a kind: OneToOne, Split, Merge, Complex, UnmatchedTarget, UnmatchedAgainst."""
    return relations_.where(F.col("kind") == kind)


def metrics(windows: DataFrame, target: str, against: str, stitch: int, tolerance: int, horizon: int | None = None) -> DataFrame:
    """Per component: lengths of both sides' unions and of their intersection, ratios, onset and recovery differences."""
    rel = relations(windows, target, against, stitch, tolerance, horizon)
    f = fragments(windows.where(F.col("source").isin(target, against)), stitch, horizon).withColumn("side", F.when(F.col("source") == target, "Target").otherwise("Against"))
    m = f.join(rel, ["side", "episode_id"]).select("component", "kind", "side", "s", "e", "record_id")
    u = union_length(m, ["component", "side"])
    both = union_length(m, ["component"]).withColumnRenamed("active", "u")
    lens = u.groupBy("component").agg(F.sum(F.when(F.col("side") == "Target", F.col("active")).otherwise(0)).alias("target_active"), F.sum(F.when(F.col("side") == "Against", F.col("active")).otherwise(0)).alias("against_active"))
    at = lambda fn, side, c: fn(F.when(F.col("side") == side, F.col(c)))
    ends = m.groupBy("component", "kind").agg(at(F.min, "Target", "s").alias("ts"), at(F.max, "Target", "e").alias("te"), at(F.min, "Against", "s").alias("os"), at(F.max, "Against", "e").alias("oe"))
    inter = F.col("target_active") + F.col("against_active") - F.col("u")
    div = lambda a, b: F.when(b > 0, a / b)
    return ends.join(lens, "component").join(both, "component").select("component", "kind", "target_active", "against_active", inter.alias("overlap"), div(inter, F.col("target_active")).alias("target_coverage"), div(inter, F.col("against_active")).alias("against_coverage"), div(inter, F.col("u")).alias("iou"),
                                                                     (F.col("os") - F.col("ts")).alias("onset_delta"), (F.col("oe") - F.col("te")).alias("recovery_delta"))


def portable(windows: DataFrame, target: str, against: str, stitch: int, tolerance: int, horizon: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, relations) for documents, which name no ids of this engine. An episode is told by its side and `index`, from 0
    on, in the order of window name, key, partition (by UTF-8 bytes, null first), start, end; a relation by the sorted indexes
    of its members.

    Episodes are numbered within their key and partition, from where those before end: one task sees a row for each key and
    partition, not the episodes."""
    group = ["side", *COMPATIBLE]
    e = form(windows.where(F.col("source").isin(target, against)), stitch, horizon).withColumn("side", F.when(F.col("source") == target, "Target").otherwise("Against"))
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("start_m", "end_m", "fragments", "active", "episode_id")))
    ahead = Window.partitionBy("side").orderBy("window_name", "key", F.col("partition_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = e.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(*[F.col(c).alias(f"b_{c}") for c in group], F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = e.join(before, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in group]).withColumn("index", F.col("before") + F.col("nth") - 1)
    rel = relations(windows, target, against, stitch, tolerance, horizon).join(own.select("side", "episode_id", "index"), ["side", "episode_id"])
    members = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("index")))).alias(side.lower())
    shown = own.select("side", "index", "window_name", "key", "partition_id", "start_m", "end_m", "fragments", "elapsed", "active", "internal_gap", "finality")
    return shown, rel.groupBy("component").agg(F.first("kind").alias("kind"), members("Target"), members("Against"), F.first("finality").alias("finality")).drop("component")


def comparison_summary(relations_: DataFrame, metrics_: DataFrame) -> DataFrame:
    """One row: episodes and matches of both sides, relations of each kind, split and merge rates, biases, micro-averaged
    coverage and IoU, and distributions of the differences over OneToOne relations."""
    side = lambda x: F.col("side") == x
    matched = ~F.col("kind").startswith("Unmatched")
    n = lambda c, name: F.count_if(c).alias(name)
    m = relations_.agg(n(side("Target"), "target_episodes"), n(side("Against"), "against_episodes"), n(side("Target") & matched, "matched_target"), n(side("Against") & matched, "matched_against"),
                       n(side("Target") & (F.col("kind") == "Split"), "split_targets"), n(side("Against") & (F.col("kind") == "Merge"), "merged_against"))
    kinds = {"OneToOne": "one_to_one", "Split": "splits", "Merge": "merges", "Complex": "complex"}
    one = lambda c: F.when(F.col("kind") == "OneToOne", c)
    deltas = {"onset": F.col("onset_delta"), "recovery": F.col("recovery_delta"), "active": F.col("against_active") - F.col("target_active"), "elapsed": F.col("recovery_delta") - F.col("onset_delta")}
    x = metrics_.select("*", *[one(c).alias(f"__{k}") for k, c in deltas.items()])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    y = x.agg(*[n(F.col("kind") == k, v) for k, v in kinds.items()], total("overlap").alias("overlap"), total("target_active").alias("ta"), total("against_active").alias("aa"), *[d for k in deltas for d in distribution(f"__{k}", k)])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    union = F.col("ta") + F.col("aa") - F.col("overlap")
    more = [c for c in y.columns if c not in ("ta", "aa")]
    return m.withColumn("__row", F.lit(1)).join(y.withColumn("__row", F.lit(1)), "__row").select(*m.columns, *more, (F.col("against_episodes") - F.col("target_episodes")).alias("count_bias"), saturating_subtract("aa", "ta").alias("active_bias"), rate("matched_target", "target_episodes").alias("target_match_rate"),
                                         rate("matched_against", "against_episodes").alias("against_match_rate"), rate("split_targets", "target_episodes").alias("split_rate"), rate("merged_against", "against_episodes").alias("merge_rate"),
                                         rate("overlap", "ta").alias("target_coverage"), rate("overlap", "aa").alias("against_coverage"), F.when(union > 0, F.col("overlap") / union).alias("iou"))


def scorecard(relations_: DataFrame) -> DataFrame:
    """The target as reference: recall, precision, F1."""
    c = relations_.agg(F.count_if(F.col("side") == "Target").alias("tn"), F.count_if((F.col("side") == "Target") & (F.col("kind") != "UnmatchedTarget")).alias("tm"), F.count_if(F.col("side") == "Against").alias("an"), F.count_if((F.col("side") == "Against") & (F.col("kind") != "UnmatchedAgainst")).alias("am"))
    r, p = F.when(F.col("tn") > 0, F.col("tm") / F.col("tn")), F.when(F.col("an") > 0, F.col("am") / F.col("an"))
    return c.select(F.col("tm").alias("matched_target"), F.col("am").alias("matched_against"), r.alias("recall"), p.alias("precision"), F.when(r.isNull() | p.isNull(), None).when(r + p == 0, 0.0).otherwise(2 * r * p / (r + p)).alias("f1"))


def match_sequence(windows: DataFrame, steps: list[str], maximum_gap: int, horizon: int | None = None) -> DataFrame:
    """Greedy ordered chains per (key, source, partition): each first candidate, by (end, start, id), takes the first unused
    candidate of every next step that starts no earlier and within the gap; complete chains use up their records. Open windows
    without a horizon fail the query when it is executed.

    A family is searched from its first candidate that ends at or after its forerunner's start, by bisection: those before
    start too early."""
    if horizon is not None:
        w = windows.where(F.col("start_position") <= horizon).withColumn("prov", F.col("end_position").isNull() | (F.col("end_position") > horizon)).withColumn("end_position", F.least(F.coalesce("end_position", F.lit(horizon)), F.lit(horizon)))
    else:
        open_ = F.raise_error(F.concat(F.lit("open evidence: "), F.coalesce("record_id", F.lit("")))).cast("long")
        w = windows.withColumn("end_position", F.coalesce(F.col("end_position").cast("long"), open_)).withColumn("prov", F.lit(False))
    w = w.where(F.col("window_name").isin(*steps)).select("window_name", "key", "source", "partition_id", "record_id", F.col("start_position").alias("s"), F.col("end_position").cast("long").alias("e"), "prov")

    def chains(rows) -> list[tuple]:
        fam: dict = {n: [] for n in steps}
        for r in rows:
            fam[r["window_name"]].append(r)
        used: set = set()
        out = []
        ends = {n: [c["e"] for c in fam[n]] for n in fam}  # ascending: a candidate that starts at s or later ends at s or later

        def after(n, prev, chain):
            own = {x["record_id"] for x in chain}
            for c in itertools.islice(fam[n], bisect.bisect_left(ends[n], prev["s"]), None):
                if c["record_id"] not in used and c["record_id"] not in own and c["s"] >= prev["s"] and max(0, c["s"] - prev["e"]) <= maximum_gap:
                    return c

        for first in fam[steps[0]]:
            if first["record_id"] in used:
                continue
            chain, gap = [first], 0
            for n in steps[1:]:
                prev = chain[-1]
                nxt = after(n, prev, chain)
                if nxt is None:
                    break
                gap += max(0, nxt["s"] - prev["e"])
                chain.append(nxt)
            else:
                used.update(x["record_id"] for x in chain)
                end = max(x["e"] for x in chain)
                out.append((first["key"], first["source"], first["partition_id"], first["s"], end, end - first["s"], gap, "Provisional" if any(x["prov"] for x in chain) else "Final", ",".join(x["record_id"] for x in chain)))
        return out

    names = ["key", "source", "partition_id", "start_m", "end_m", "elapsed", "total_gap", "finality", "record_ids"]

    def run(batches):
        """Lanes arrive whole and one after another: a task holds one lane at a time, without a frame for each."""
        lane, held, out = None, [], []
        for b in batches:
            for r in b.to_pylist():
                k = (r["key"], r["source"], r["partition_id"])
                if k != lane:
                    out += chains(held)
                    lane, held = k, []
                held.append(r)
            yield pack(out)
            out = []
        yield pack(out + chains(held))

    def pack(rows):
        kinds = [pa.string()] * 3 + [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    w = w.repartition("key", "source", "partition_id").sortWithinPartitions("key", "source", "partition_id", "e", "s", "record_id")
    return w.mapInArrow(run, "key string, source string, partition_id string, start_m long, end_m long, elapsed long, total_gap long, finality string, record_ids string")
