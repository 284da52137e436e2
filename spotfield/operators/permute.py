"""Permutation inference on edges.

Shuffles rank spots by md5(seed:replicate:spot), so every engine and every run draws the same ones. Replicate 0 is the
observed table. Spots with a NULL group take no part. Samples that a task can hold are shuffled in tasks, each for some
replicates (``shuffles``), so only counts leave them; in larger ones, and where units of
``interaction_null`` are missing, a replicate is a relation: values joined back by rank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.numbers import with_bh
from . import shuffles as sh


def replicates(values: DataFrame, column: str, permutations: int, seed: int, group: Column | None = None) -> DataFrame:
    """(sample, perm, spot, column): perm 0 as given, 1..P shuffled within ``group`` (N1, N2); single spots stay."""
    base = values.select("sample", "spot", F.col(column).alias(column), (F.lit(0) if group is None else group).alias("grp")).where("grp is not null")
    many = base.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    per = Window.partitionBy("sample", "perm", "grp")
    place = many.withColumn("n", F.row_number().over(per.orderBy("spot"))).select("sample", "perm", "grp", "n", "spot")
    drawn = many.withColumn("n", F.row_number().over(per.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "perm", "spot")), "spot"))).select("sample", "perm", "grp", "n", column)
    return base.select("sample", F.lit(0).alias("perm"), "spot", column).unionByName(place.join(drawn.hint("merge"), ["sample", "perm", "grp", "n"]).select("sample", "perm", "spot", column))


def replicated(spots: DataFrame, edges: DataFrame, permutations: int, schema: str, work: Callable, relations: Callable[[DataFrame, DataFrame], DataFrame], gap: str = "false") -> DataFrame:
    """A statistic of every replicate, columns of ``schema`` after the sample: by ``work`` in tasks, or by ``relations`` (of spots
    and edges) for samples that no task holds or with a spot where ``gap`` is true."""
    spots, edges = durable(spots), durable(edges)
    sizes = durable(sh.sizes(spots, edges, gap))
    largest, rest = sizes.agg(F.max(F.when(F.col("held"), F.col("n"))), F.max(F.when(~F.col("held"), F.col("n")))).first()
    if rest is None:
        return sh.in_tasks(spots, edges, largest or 0, permutations, schema, work)
    held, large = ((spots.join(of, "sample", "left_semi"), edges.join(of, "sample", "left_semi")) for of in (sizes.where("held"), sizes.where("not held")))
    by_relation = relations(*large)
    return by_relation if largest is None else by_relation.unionByName(sh.in_tasks(*held, largest, permutations, schema, work))


def inference(stats: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observed, null mean and deviation (ddof 1), z and two-sided empirical p from one row per replicate."""
    stats = durable(stats)  # read twice; a row for each replicate and key
    obs = F.max(F.when(F.col("perm") == 0, F.col(value)))
    null = F.when(F.col("perm") > 0, F.col(value))
    m = stats.groupBy("sample", *keys).agg(obs.alias("observed"), F.avg(null).alias("expected"), F.stddev_samp(null).alias("sd"))
    far = stats.where("perm > 0").join(m, ["sample", *keys]).groupBy("sample", *keys).agg(F.sum((F.abs(F.col(value) - F.col("expected")) >= F.abs(F.col("observed") - F.col("expected")) - 1e-12).cast("long")).alias("far"), F.count(value).alias("n"))
    z = F.try_divide(F.col("observed") - F.col("expected"), F.nullif(F.col("sd"), F.lit(0.0)))
    return m.join(far, ["sample", *keys]).select("sample", *keys, "observed", "expected", F.col("sd").alias("permutation_sd"), z.alias("z"), ((F.col("far") + 1) / (F.col("n") + 1)).alias("empirical_p"))


def directed(rows: DataFrame, positive: str = "enriched", negative: str = "depleted") -> DataFrame:
    """BH within sample and table, then a direction where q <= 0.05."""
    rows = with_bh(rows, "empirical_p", "q_value_bh_fdr", ["sample"])
    call = F.when((F.col("q_value_bh_fdr") <= 0.05) & (F.col("z") > 0), positive).when((F.col("q_value_bh_fdr") <= 0.05) & (F.col("z") < 0), negative).otherwise("neutral_or_inconclusive")
    return rows.withColumn("association_direction", call)


def _codes(values: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Numbers of the values in their order, and the values by number."""
    coded = values.combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    return number[coded.indices.to_numpy()], [names[k] for k in order]


def _times(keys: np.ndarray, top: int) -> tuple[list, list]:
    """The different keys (below top) and how often each occurs."""
    if top > len(keys) + 1000:
        return tuple(x.tolist() for x in np.unique(keys, return_counts=True))
    n = np.bincount(keys, minlength=top)
    return np.flatnonzero(n).tolist(), n[n > 0].tolist()


def categorical_enrichment(labels: DataFrame, edges: DataFrame, permutations: int, seed: int, group: Column | None = None) -> DataFrame:
    """Edges per unordered pair of labels, pairs without edges included; edges at NULL labels drop."""
    taken = labels.select("sample", "spot", "label", (F.lit(0) if group is None else group).alias("grp")).where("label is not null and grp is not null")

    def work(spots: pa.Table, edges: pa.Table, perms: range) -> dict[str, list]:
        spots = sh.by_spot(spots)
        codes, names = _codes(spots["label"])
        draw = sh.Draws(spots["spot"].to_numpy(), seed, _codes(spots["grp"])[0])
        i, j, _ = sh.ends(draw.ids, edges)
        out: dict[str, list] = {"perm": [], "label_a": [], "label_b": [], "n": []}
        for perm in perms:
            v = codes[draw(perm)]
            a, b = v[i], v[j]
            pairs, n = _times(np.minimum(a, b) * len(names) + np.maximum(a, b), len(names) ** 2)
            out["perm"] += [perm] * len(n)
            out["label_a"] += [names[k // len(names)] for k in pairs]
            out["label_b"] += [names[k % len(names)] for k in pairs]
            out["n"] += n
        kind = spots.schema.field("label").type
        return {"perm": pa.array(out["perm"], pa.int32()), "label_a": pa.array(out["label_a"], kind), "label_b": pa.array(out["label_b"], kind), "n": pa.array(out["n"], pa.int64())}

    def relations(spots: DataFrame, edges: DataFrame) -> DataFrame:
        reps = replicates(spots, "label", permutations, seed, F.col("grp"))
        ends = edges.join(reps.toDF("sample", "perm", "i", "a").hint("merge"), ["sample", "i"]).join(reps.toDF("sample", "perm", "j", "b").hint("merge"), ["sample", "perm", "j"])
        return ends.groupBy("sample", "perm", F.least("a", "b").alias("label_a"), F.greatest("a", "b").alias("label_b")).agg(F.count(F.lit(1)).alias("n"))

    kind = labels.schema["label"].dataType.simpleString()
    counts = replicated(taken, edges.select("sample", "i", "j"), permutations, f"perm int, label_a {kind}, label_b {kind}, n long", work, relations)
    states = labels.where("label is not null").select("sample", "label").distinct()
    grid = states.toDF("sample", "label_a").join(states.toDF("sample", "label_b"), "sample").where("label_a <= label_b").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    full = grid.join(counts, ["sample", "perm", "label_a", "label_b"], "left").fillna(0, ["n"]).withColumn("n", F.col("n").cast("double"))
    out = inference(full, ["label_a", "label_b"], "n").withColumn("observed_expected_ratio", F.try_divide("observed", "expected"))
    return directed(out).withColumn("interpretation", F.when(F.col("z").isNull(), "not_interpretable").when(F.col("z") >= 0, "enrichment").otherwise("depletion"))


def binary_association(masks: DataFrame, edges: DataFrame, pairs: list[tuple[str, str]], permutations: int, seed: int) -> DataFrame:
    """Same-spot overlap and neighbouring association of masks (sample, spot, mask, on), permuting the second of a pair."""
    pairs = list(dict.fromkeys(pairs))

    def work(spots: pa.Table, edges: pa.Table, perms: range) -> dict[str, list]:
        (mask, names), ids, whole = _codes(spots["mask"]), spots["spot"].to_numpy(), not spots["on"].null_count
        yes, no = (pc.fill_null(on, False).to_numpy() for on in (spots["on"], pc.invert(spots["on"])))  # neither: missing
        by = {}
        for x in {y for pair in pairs for y in pair}:
            at = np.flatnonzero(mask == (names.index(x) if x in names else -1))
            at = at[np.argsort(ids[at], kind="stable")]
            by[x] = (ids[at], yes[at], no[at])
        del spots, mask, ids, yes, no
        drawn: list[sh.Draws] = []  # masks of the same spots share theirs
        which = {}
        for x in dict.fromkeys(b for _, b in pairs):
            at = [k for k, d in enumerate(drawn) if np.array_equal(d.ids, by[x][0])]
            drawn += [] if at else [sh.Draws(by[x][0], seed)]
            which[x] = at[0] if at else len(drawn) - 1
        graphs: list[tuple] = []  # edges between the spots of a pair, one for the pairs that the same spots have
        parts = []
        for x, y in pairs:
            both = np.intersect1d(by[x][0], by[y][0])
            if not (same := [g for g in graphs if np.array_equal(g[0], both)]):
                graphs += (same := [(both, *sh.ends(both, edges)[:2])])
            _, i, j = same[0]
            a, na = (v[sh.found(by[x][0], both)] for v in by[x][1:])
            parts.append((x, y, a, na, a[i], a[j], sh.found(by[y][0], both), i, j))
        del edges

        def times(true: np.ndarray, false: Callable[[], np.ndarray]) -> float | None:
            """How often it is true; like a sum, NULL where it is missing throughout."""
            n = np.count_nonzero(true)
            return float(n) if n or whole or false().any() else None

        rows = []
        for perm in perms:
            sources = [d(perm) for d in drawn]
            for x, y, a, na, ai, aj, at, i, j in parts:
                b, nb = (v[sources[which[y]]][at] for v in by[y][1:])
                if len(a):
                    rows.append((perm, x, y, "same_spot_overlap", times(a & b, lambda: na | nb)))
                if len(i):
                    rows.append((perm, x, y, "neighboring_association", times((ai & b[j]) | (b[i] & aj), lambda: (na[i] | nb[j]) & (nb[i] | na[j]))))
        perm, x, y, mode, n = zip(*rows, strict=True) if rows else ([],) * 5
        return {"perm": pa.array(perm, pa.int32()), "mask_a": pa.array(x, pa.string()), "mask_b": pa.array(y, pa.string()), "mode": pa.array(mode, pa.string()), "n": pa.array(n, pa.float64())}

    def relations(masks: DataFrame, edges: DataFrame) -> DataFrame:
        wanted = F.broadcast(masks.sparkSession.createDataFrame(pairs, "mask_a string, mask_b string"))
        bs = None
        for name in dict.fromkeys(b for _, b in pairs):
            one = replicates(masks.where(F.col("mask") == name), "on", permutations, seed).withColumn("mask_b", F.lit(name))
            bs = one if bs is None else bs.unionByName(one)
        a = masks.join(wanted, masks["mask"] == wanted["mask_a"]).select("sample", "spot", "mask_a", "mask_b", F.col("on").alias("a"))
        b = bs.withColumnRenamed("on", "b").hint("merge")
        same = a.join(b, ["sample", "spot", "mask_b"]).groupBy("sample", "mask_a", "mask_b", "perm").agg(F.sum((F.col("a") & F.col("b")).cast("double")).alias("n")).withColumn("mode", F.lit("same_spot_overlap"))
        e = edges.join(a.select("sample", F.col("spot").alias("i"), "mask_a", "mask_b", F.col("a").alias("ai")), ["sample", "i"]).join(a.select("sample", F.col("spot").alias("j"), "mask_a", "mask_b", F.col("a").alias("aj")), ["sample", "j", "mask_a", "mask_b"])
        e = e.join(b.select("sample", F.col("spot").alias("i"), "mask_b", "perm", F.col("b").alias("bi")).hint("merge"), ["sample", "i", "mask_b"]).join(b.select("sample", F.col("spot").alias("j"), "mask_b", "perm", F.col("b").alias("bj")).hint("merge"), ["sample", "j", "mask_b", "perm"])
        near = e.groupBy("sample", "mask_a", "mask_b", "perm").agg(F.sum(((F.col("ai") & F.col("bj")) | (F.col("bi") & F.col("aj"))).cast("double")).alias("n")).withColumn("mode", F.lit("neighboring_association"))
        return same.unionByName(near).select("sample", "perm", "mask_a", "mask_b", "mode", "n")

    named = masks.select("sample", "spot", "mask", "on").where(F.col("mask").isin(sorted({y for pair in pairs for y in pair})))
    stats = replicated(named, edges.select("sample", "i", "j"), permutations, "perm int, mask_a string, mask_b string, mode string, n double", work, relations)
    return directed(inference(stats, ["mask_a", "mask_b", "mode"], "n"))


def continuous_edge_stats(values: DataFrame, edges: DataFrame, pairs: list[tuple[str, str]], permutations: int, seed: int) -> DataFrame:
    """Weighted mean over edges of (x_i y_j + y_i x_j) / 2, permuting y. ``values`` has a column for each field."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))

    def work(spots: pa.Table, edges: pa.Table, perms: range) -> dict[str, list]:
        spots = sh.by_spot(spots)
        ids, weight = spots["spot"].to_numpy(), edges["weight"].to_numpy()
        parts = []
        for x, y in pairs:
            whole = np.flatnonzero(spots[x].is_valid().to_numpy() & spots[y].is_valid().to_numpy())
            i, j, kept = sh.ends(ids[whole], edges)
            parts.append((f"I_{x}{y}".upper(), whole, spots[x].to_numpy()[whole], spots[y].to_numpy()[whole], i, j, weight[kept]))
        drawn: list[sh.Draws] = []  # one for the pairs that the same spots have
        for _, whole, *_ in parts:
            drawn.append(next((d for d in drawn if np.array_equal(d.ids, ids[whole])), None) or sh.Draws(ids[whole], seed))
        rows = []
        for perm in perms:
            sources = {id(d): d(perm) for d in {id(d): d for d in drawn}.values()}
            for d, (name, _, x, y, i, j, w) in zip(drawn, parts, strict=True):
                if len(i):
                    v = y[sources[id(d)]]
                    rows.append((perm, name, float((w * (0.5 * (x[i] * v[j] + v[i] * x[j]))).sum() / w.sum())))
        perm, name, v = zip(*rows, strict=True) if rows else ([],) * 3
        return {"perm": pa.array(perm, pa.int32()), "statistic": pa.array(name, pa.string()), "v": pa.array(v, pa.float64())}

    def relations(values: DataFrame, w: DataFrame) -> DataFrame:
        out = None
        for x, y in pairs:
            reps = replicates(values.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("yy", F.col(y)), "yy", permutations, seed)
            v = reps.join(values.select("sample", "spot", F.col(x).alias("xx")), ["sample", "spot"])
            e = w.join(v.select("sample", "perm", F.col("spot").alias("i"), F.col("xx").alias("xi"), F.col("yy").alias("yi")).hint("merge"), ["sample", "i"]).join(v.select("sample", "perm", F.col("spot").alias("j"), F.col("xx").alias("xj"), F.col("yy").alias("yj")).hint("merge"), ["sample", "perm", "j"])
            one = e.groupBy("sample", "perm").agg((F.sum(F.col("weight") * 0.5 * (F.col("xi") * F.col("yj") + F.col("yi") * F.col("xj"))) / F.sum("weight")).alias("v")).select("sample", "perm", F.lit(f"I_{x}{y}".upper()).alias("statistic"), "v")
            out = one if out is None else out.unionByName(one)
        return out

    w = edges.where("weight > 0").select("sample", "i", "j", F.col("weight").cast("double").alias("weight"))
    stats = replicated(values.select("sample", "spot", *(F.col(c).cast("double").alias(c) for c in columns)), w, permutations, "perm int, statistic string, v double", work, relations)
    return directed(inference(stats, ["statistic"], "v"), "above_null", "below_null")


def _round9(x: np.ndarray) -> np.ndarray:
    """To 9 decimals, halves away from zero."""
    t = np.abs(x) * 1e9
    low = np.floor(t)
    return np.copysign((low + (t - low >= 0.5)) / 1e9, x)


def interaction_null(units: DataFrame, edges: DataFrame, permutations: int, seed: int, eps: float = 1e-9) -> DataFrame:
    """The five indices of A18 for replicates of (sample, spot, cu, su) that permute su."""

    def work(spots: pa.Table, edges: pa.Table, perms: range) -> dict[str, list]:
        spots = sh.by_spot(spots)
        draw, cu, su = sh.Draws(spots["spot"].to_numpy(), seed), spots["cu"].to_numpy(), spots["su"].to_numpy()
        nodes = np.unique(np.concatenate([draw.ids, edges["i"].to_numpy(), edges["j"].to_numpy()]))
        i, j, _ = sh.ends(nodes, edges)
        own = sh.found(nodes, draw.ids)
        has = sh.found(draw.ids, nodes)
        spot, other = np.concatenate([i, j]), has[np.concatenate([j, i])]
        spot, other = spot[other >= 0], other[other >= 0]
        spot, other = np.concatenate([spot, own]).astype(np.int32), np.concatenate([other, np.arange(len(own))]).astype(np.int32)
        times = np.bincount(spot, minlength=len(nodes))
        local = np.flatnonzero(times)
        mean = lambda v: _round9(np.bincount(spot, v[other], len(nodes))[local] / times[local])
        lc, role = mean(cu), np.zeros(len(nodes), np.int8)
        rows = []
        for perm in perms:
            ls = mean(su[draw(perm)])
            lo, hi, diff = np.minimum(lc, ls), np.maximum(lc, ls), _round9(lc - ls)
            role[local] = np.where(hi < 0.5, 0, np.where(diff >= 0.15, 1, np.where(diff <= -0.15, -1, 0)))
            both = role[i] * role[j]
            told = int(np.count_nonzero(both))
            if len(local):
                apart = np.abs(lc - ls)
                rows.append((perm, lo.mean(), apart.mean(), (1 - apart / (lc + ls + eps)).mean(), lo.sum() / (hi.sum() + eps), (both == -1).sum() / told if told else None, told or None))
        columns = zip(*rows, strict=True) if rows else ([],) * 7
        kinds = {"perm": pa.int32(), "coexistence": pa.float64(), "antagonism": pa.float64(), "balance": pa.float64(), "overlap": pa.float64(), "dominance_mixing": pa.float64(), "informative_edges": pa.int64()}
        return {name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), columns, strict=True)}

    def relations(units: DataFrame, edges: DataFrame) -> DataFrame:
        reps = replicates(units, "su", permutations, seed).hint("merge").join(units.select("sample", "spot", "cu"), ["sample", "spot"])
        return interaction_values(reps, edges, eps)

    return replicated(units.select("sample", "spot", "cu", "su"), edges.select("sample", "i", "j"), permutations, "perm int, coexistence double, antagonism double, balance double, overlap double, dominance_mixing double, informative_edges long", work, relations, gap="cu is null or su is null")


def interaction_values(units: DataFrame, edges: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Five indices from (sample, perm, spot, cu, su): local means over spot and neighbours, then coexistence, antagonism,
    balance, overlap and the share of informative edges between C- and S-dominant spots."""
    both = edges.select("sample", F.col("i").alias("spot"), F.col("j").alias("other")).unionByName(edges.select("sample", F.col("j").alias("spot"), F.col("i").alias("other")))
    own = units.select("sample", "perm", "spot", "cu", "su")
    around = both.join(own.select("sample", "perm", F.col("spot").alias("other"), "cu", "su").hint("merge"), ["sample", "other"]).select("sample", "perm", "spot", "cu", "su").unionByName(own)
    local = around.groupBy("sample", "perm", "spot").agg(F.round(F.avg("cu"), 9).alias("lc"), F.round(F.avg("su"), 9).alias("ls"))
    lo, hi, d = F.least("lc", "ls"), F.greatest("lc", "ls"), F.abs(F.col("lc") - F.col("ls"))
    spot = local.groupBy("sample", "perm").agg(F.avg(lo).alias("coexistence"), F.avg(d).alias("antagonism"), F.avg(1 - d / (F.col("lc") + F.col("ls") + eps)).alias("balance"), (F.sum(lo) / (F.sum(hi) + eps)).alias("overlap"))
    diff = F.round(F.col("lc") - F.col("ls"), 9)
    role = F.when(hi < 0.5, None).when(diff >= 0.15, 1).when(diff <= -0.15, -1)
    roles = local.select("sample", "perm", "spot", role.alias("role")).where("role is not null")
    e = edges.select("sample", "i", "j").join(roles.toDF("sample", "perm", "i", "ri").hint("merge"), ["sample", "i"]).join(roles.toDF("sample", "perm", "j", "rj").hint("merge"), ["sample", "perm", "j"])
    mixing = e.groupBy("sample", "perm").agg(F.avg((F.col("ri") * F.col("rj") == -1).cast("double")).alias("dominance_mixing"), F.count(F.lit(1)).alias("informative_edges"))
    return spot.join(mixing, ["sample", "perm"], "left")
