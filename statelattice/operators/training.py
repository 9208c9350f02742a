"""Learning: Baum-Welch (maximum likelihood and MAP), Viterbi training, segmental k-means.

Models are values: a step takes one and returns another. Sequences are packed once (see blocks). The expectation step
is one Spark job without a shuffle that reduces the blocks of each task to a row of sufficient statistics; only these
rows reach the driver, where the maximisation step solves for the new parameters. Emission fits that need the data again (see
emissions.Emission.fitting) ask for further sums under the same posteriors.

Sequence tables are (seq_id, xs). Trainers that iterate keep the packed blocks cached.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logspace import safe_log
from ..functions.special import ZERO
from . import blocks, inference
from .emissions import Discrete, Emission, Stat, fit_groups, fit_many, of_arrays
from .model import Hmm
from .topology import Topology, enforce


@dataclass(frozen=True)
class Expectation:
    """Expected counts under a model: sums over all sequences of finite likelihood."""

    sequences: int
    logp: float
    initial: np.ndarray
    transitions: np.ndarray
    leaving: np.ndarray
    occupancy: np.ndarray


Request = tuple[Hmm, dict[int, dict[str, Stat]]]


FIRST = {"sum": 0.0, "min": math.inf, "max": -math.inf}
MERGE = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def _totals(packed: DataFrame, hows: dict[int, list[str]], add: Callable[[blocks.Block, dict[int, np.ndarray]], None], multivariate: bool) -> dict[int, np.ndarray]:
    """Rows of values, each combined as `hows` says: add() adds a block to a task's rows, and a task's rows are all that
    reaches the driver, where they are combined in the order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {r: np.array([FIRST[how] for how in h]) for r, h in hows.items()}
        for batch in batches:
            for data in blocks.unpacked(batch, multivariate):
                add(data, rows)
        columns = [pa.array(list(rows), pa.int32()), pa.array([v.tobytes() for v in rows.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["r", "v"])

    found = packed.mapInArrow(run, "r int, v binary").collect()  # one row a task and model
    out = {}
    for r, h in hows.items():
        each = np.stack([np.array([FIRST[how] for how in h]), *(np.frombuffer(x["v"]) for x in found if x["r"] == r)])
        kind = np.array(h)
        out[r] = np.empty(len(h))
        for how, merge in MERGE.items():
            out[r][kind == how] = merge.reduce(each[:, kind == how], 0)
    return out


def _statistics(keys: list[tuple[int, str, str]], wants: dict[int, dict[str, Stat]], row: np.ndarray, at: int, of: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> None:
    """Merges the statistics of a block, of(state) giving observations and weights, into row from `at` on."""
    found = {i: of_arrays(want, *of(i)) for i, want in wants.items()}
    for k, (i, name, how) in enumerate(keys, at):
        row[k] = MERGE[how](row[k], found[i][name])


def _keys(wants: dict[int, dict[str, Stat]]) -> list[tuple[int, str, str]]:
    return [(i, name, how) for i, want in wants.items() for name, (how, _) in want.items()]


def _named(keys: list[tuple[int, str, str]], wants: dict[int, dict[str, Stat]], values: np.ndarray) -> dict[int, dict[str, float]]:
    out: dict[int, dict[str, float]] = {i: {} for i in wants}
    for (i, name, _), v in zip(keys, values, strict=True):
        out[i][name] = float(v)
    return out


def _reduce(packed: DataFrame, requests: dict[int, Request]) -> dict[int, tuple[Expectation, dict[int, dict[str, float]]]]:
    """The expectation step of several models over packed sequences, and further statistics under their posteriors, in one job."""
    keys = {r: _keys(wants) for r, (_, wants) in requests.items()}
    # sums: sequences, logp, initial, transitions, leaving, occupancy, then the emission statistics
    width = {r: 2 + 3 * model.states + model.states**2 for r, (model, _) in requests.items()}

    def add(data: blocks.Block, rows: dict[int, np.ndarray]) -> None:
        for r, (model, wants) in requests.items():
            for e in blocks.expected(model, data):
                rows[r][: width[r]] += np.concatenate([[e.sequences, e.logp], e.initial, e.transitions.reshape(-1), e.leaving, e.occupancy])
                _statistics(keys[r], wants, rows[r], width[r], lambda i, e=e: (e.xs, e.gamma[i]))

    hows = {r: ["sum"] * width[r] + [how for _, _, how in keys[r]] for r in requests}
    found = _totals(packed, hows, add, next(iter(requests.values()))[0].multivariate)
    out = {}
    for r, (model, wants) in requests.items():
        n, v = model.states, found[r]
        parts = np.split(v[: width[r]], np.cumsum([2, n, n * n, n]))
        out[r] = Expectation(int(round(v[0])), float(v[1]), parts[1], parts[2].reshape(n, n), parts[3], parts[4]), _named(keys[r], wants, v[width[r] :])
    return out


def expectation(sequences: DataFrame, model: Hmm) -> Expectation:
    """The expectation step alone."""
    model.require_initialized()
    return _reduce(blocks.pack(sequences, model.multivariate, model.states), {0: (model, {})})[0][0]


def _share(counts: np.ndarray, pseudo: float = 0.0) -> np.ndarray:
    """Counts plus pseudo-counts as probabilities; uniform where there are next to none."""
    total = counts.sum() + pseudo * len(counts)
    return np.full(len(counts), 1 / len(counts)) if total < ZERO else (counts + pseudo) / total


@dataclass(frozen=True)
class Step:
    """One iteration: the new model, and the log-likelihood (hard: path log-probability) of the one before it."""

    model: Hmm
    logp: float


@dataclass(frozen=True)
class Training:
    model: Hmm
    history: tuple[float, ...] = field(default=())
    converged: bool = False
    reached_max_iterations: bool = False

    @property
    def logp(self) -> float:
        return self.history[-1] if self.history else -math.inf


def _steps(packed: DataFrame, models: dict[int, Hmm], pseudo_count: float, topology: Topology | None) -> dict[int, Step | ValueError]:
    """One pass of expectation-maximisation for each model, all in the same jobs: a Step, or why there is none."""
    expected: dict[int, Expectation] = {}

    def answer(wants: dict[Any, dict[str, Stat]]) -> dict[Any, dict[str, float]]:
        asking = {r: (models[r], {i: want for (q, i), want in wants.items() if q == r}) for r in {q for q, _ in wants}}
        found = _reduce(packed, asking)
        for r, (e, _) in found.items():
            expected.setdefault(r, e)
        return {(r, i): found[r][1][i] for r, i in wants}

    fitted = fit_many({(r, i): e for r, m in models.items() for i, e in enumerate(m.emissions)}, answer, weighted=True)
    out: dict[int, Step | ValueError] = {}
    for r, model in models.items():
        e = expected[r]
        if not e.sequences:
            out[r] = ValueError("no sequence has a finite likelihood under the model")
            continue
        pi = _share(e.initial, pseudo_count)
        # rows are divided by what left the state, which is their sum up to rounding
        left = e.leaving + pseudo_count * model.states
        trans = np.array([(row + pseudo_count) / n if n >= ZERO else np.full(model.states, 1 / model.states) for row, n in zip(e.transitions, left, strict=True)])
        emissions = [smooth(fitted[r, i], e.occupancy[i], pseudo_count) for i in range(model.states)]
        new = Hmm(tuple(pi), tuple(map(tuple, trans)), tuple(emissions))
        out[r] = Step(enforce(new, topology) if topology else new, e.logp)
    return out


def _check(pseudo_count: float, *models: Hmm) -> None:
    if not (math.isfinite(pseudo_count) and pseudo_count >= 0):
        raise ValueError("pseudo_count must be finite and not negative")
    for model in models:
        model.require_initialized()


def baum_welch_step(sequences: DataFrame, model: Hmm, pseudo_count: float = 0.0, topology: Topology | None = None) -> Step:
    """One pass of expectation-maximisation. With pseudo_count > 0, symmetric Dirichlet priors on the initial and
    transition probabilities and on Discrete emissions (MAP). Raises if no sequence has a finite likelihood."""
    _check(pseudo_count, model)
    step = _steps(blocks.pack(sequences, model.multivariate, model.states), {0: model}, pseudo_count, topology)[0]
    if isinstance(step, ValueError):
        raise step
    return step


def smooth(emission: Emission, weight: float, pseudo_count: float) -> Emission:
    """A Discrete emission with pseudo-counts; other families as they are."""
    if not isinstance(emission, Discrete) or pseudo_count <= 0 or weight <= 0:
        return emission
    total = weight + pseudo_count * len(emission.probs)
    return Discrete(tuple((p * weight + pseudo_count) / total for p in emission.probs))


def log_prior(model: Hmm, pseudo_count: float) -> float:
    """The unnormalised log prior of MAP training: 0 without pseudo-counts, minus infinity at a zero probability."""
    if pseudo_count == 0:
        return 0.0
    values = [*model.pi, *(p for row in model.trans for p in row), *(p for e in model.emissions if isinstance(e, Discrete) for p in e.probs)]
    return pseudo_count * float(safe_log(np.array(values)).sum())


def baum_welch_many(
    sequences: DataFrame, models: dict[int, Hmm], max_iterations: int = 500, tolerance: float = 3e-7, pseudo_count: float = 0.0, topology: Topology | None = None
) -> dict[int, Training | ValueError]:
    """baum_welch from several models side by side: an iteration is one job however many they are. A model that has
    converged, or can't go on, drops out of the jobs."""
    _check(pseudo_count, *models.values())
    if not models:
        return {}
    now, history = dict(models), {r: [] for r in models}
    done: dict[int, Training | ValueError] = {}
    packed = blocks.pack(sequences, next(iter(models.values())).multivariate, max(m.states for m in models.values())).cache()
    try:
        for _ in range(max_iterations):
            going = {r: m for r, m in now.items() if r not in done}
            if not going:
                break
            for r, step in _steps(packed, going, pseudo_count, topology).items():
                if isinstance(step, ValueError):
                    done[r] = step
                    continue
                now[r], own = step.model, history[r]
                own.append(step.logp)
                if len(own) > 1 and math.isfinite(own[-2]) and abs(own[-1] - own[-2]) <= tolerance * (abs(own[-1]) + 1):
                    done[r] = Training(now[r], tuple(own), True)
    finally:
        packed.unpersist()
    return {r: done.get(r, Training(now[r], tuple(history[r]), False, True)) for r in models}


def baum_welch(
    sequences: DataFrame, model: Hmm, max_iterations: int = 500, tolerance: float = 3e-7, pseudo_count: float = 0.0, topology: Topology | None = None
) -> Training:
    """Steps until the log-likelihood changes by no more than tolerance, relative to its size plus one."""
    done = baum_welch_many(sequences, {0: model}, max_iterations, tolerance, pseudo_count, topology)[0]
    if isinstance(done, ValueError):
        raise done
    return done


# -- hard assignments ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HardConfig:
    tolerance: float = 1e-6
    max_iterations: int = 500
    window: int = 3

    def __post_init__(self) -> None:
        if self.window < 2:
            raise ValueError("window must be at least 2")


FAST, BALANCED, PRECISE = HardConfig(1e-5, 100, 2), HardConfig(1e-6, 500, 3), HardConfig(1e-8, 2000, 5)


def _assigned(sequences: DataFrame, paths: DataFrame) -> DataFrame:
    """(seq_id, t, state, x, following) of all steps."""
    both = sequences.join(paths.select("seq_id", "path"), "seq_id").where("path IS NOT NULL")
    rows = both.select("seq_id", F.posexplode(F.arrays_zip("path", "xs", F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))).alias("next"))).alias("t", "z"))
    names = rows.schema["z"].dataType.names
    return rows.select("seq_id", "t", F.col(f"z.{names[0]}").alias("state"), F.col(f"z.{names[1]}").alias("x"), F.col(f"z.`{names[2]}`").alias("following"))


def hard_counts(steps: DataFrame) -> DataFrame:
    """(state, following, n) of assigned steps: transition counts, and first states as rows without `following`."""
    moves = steps.where(F.col("following").isNotNull()).groupBy("state", "following").agg(F.count(F.lit(1)).alias("n"))
    starts = steps.where("t = 0").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return moves.unionByName(starts.withColumn("following", F.lit(None).cast("int")))


def _hard_model(model: Hmm, initial: np.ndarray, moves: np.ndarray, fitted: dict[int, Emission], starts_of: float | None = None) -> Hmm:
    """The model of hard counts; states without a fit are reset."""
    pi = initial / starts_of if starts_of else _share(initial)
    trans = np.array([_share(row) for row in moves])
    return Hmm(tuple(pi), tuple(map(tuple, trans)), tuple(fitted.get(i, model.emissions[i].reset()) for i in range(model.states)))


def _maximise(steps: DataFrame, model: Hmm, starts_of: float | None = None) -> Hmm:
    n = model.states
    initial, moves, seen = np.zeros(n), np.zeros((n, n)), np.zeros(n)
    counts = steps.groupBy("state", "following", (F.col("t") == 0).alias("first")).agg(F.count(F.lit(1)).alias("n"))
    for r in counts.collect():  # 2 * states * (states + 1) rows at most
        seen[r["state"]] += r["n"]
        if r["first"]:
            initial[r["state"]] += r["n"]
        if r["following"] is not None:
            moves[r["state"], r["following"]] += r["n"]
    fitted = fit_groups(steps, {i: e for i, e in enumerate(model.emissions) if seen[i]}, "state", "x")
    return _hard_model(model, initial, moves, fitted, starts_of)


def _assign(packed: DataFrame, model: Hmm, wants: dict[int, dict[str, Stat]]) -> tuple[np.ndarray, dict[int, dict[str, float]]]:
    """Sums over the best paths (sequences, log-probability, first states, moves, steps of each state) and statistics
    of each state's observations, in one job."""
    n, keys = model.states, _keys(wants)
    width = 2 + 2 * n + n * n

    def add(data: blocks.Block, rows: dict[int, np.ndarray]) -> None:
        a = blocks.assigned(model, data)
        seen = np.bincount(a.states, minlength=n)
        rows[0][:width] += np.concatenate([[a.sequences, a.logp], a.initial, a.moves.reshape(-1), seen])

        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            x = a.xs[a.states == i]
            return x, np.ones(len(x))

        _statistics(keys, wants, rows[0], width, of)

    row = _totals(packed, {0: ["sum"] * width + [how for _, _, how in keys]}, add, model.multivariate)[0]
    return row[:width], _named(keys, wants, row[width:])


def _hard_step(packed: DataFrame, model: Hmm) -> Step:
    n, first = model.states, {}
    for i, e in enumerate(model.emissions):
        first[i] = next(e.fitting(False), {})
    # the first round of every fit comes with the counts
    sums, values = _assign(packed, model, first)
    if not sums[0]:
        return Step(model, -math.inf)
    _, initial, moves, seen = np.split(sums, np.cumsum([2, n, n * n]))
    known = [values]
    answer = lambda wants: known.pop() if known else _assign(packed, model, wants)[1]
    fitted = fit_many({i: e for i, e in enumerate(model.emissions) if seen[i]}, answer, weighted=False)
    return Step(_hard_model(model, initial, moves.reshape(n, n), fitted), float(sums[1]))


def viterbi_step(sequences: DataFrame, model: Hmm) -> Step:
    """Hard assignment by the best paths, then counts and unweighted fits; a state without steps is reset. Sequences
    of probability 0 are left out; if that is all of them the model stays."""
    model.require_initialized()
    return _hard_step(blocks.pack(sequences, model.multivariate, model.states), model)


def viterbi_training(sequences: DataFrame, model: Hmm, config: HardConfig = BALANCED) -> Training:
    """Hard steps until the path log-probabilities of a whole window differ by less than the tolerance."""
    model.require_initialized()
    history: list[float] = []
    packed = blocks.pack(sequences, model.multivariate, model.states).cache()
    try:
        for _ in range(config.max_iterations):
            step = _hard_step(packed, model)
            model = step.model
            history.append(step.logp)
            last = history[-config.window :]
            if len(last) == config.window and all(abs(b - a) < config.tolerance for a, b in zip(last, last[1:], strict=False)):
                return Training(model, tuple(history), True)
        return Training(model, tuple(history), False, True)
    finally:
        packed.unpersist()


def even_paths(sequences: DataFrame, states: int) -> DataFrame:
    """(seq_id, path): all observations in list order cut into `states` even runs.

    The sequences' offsets are sums over range partitions of the ids; one sum a partition is gathered."""
    sizes = inference._filled(sequences).select("seq_id", F.size("xs").cast("long").alias("n"))
    # checkpointed: a partition that is computed again must keep its number
    dealt = _cut(sizes.repartitionByRange(F.col("seq_id")).sortWithinPartitions("seq_id").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("n").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)
    total = dealt.agg(F.sum("n")).first()[0] or 0
    offset = F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))
    state = lambda i: F.floor((F.col("offset") + i) * states / F.lit(max(total, 1))).cast("int")
    rows = dealt.join(parts, "part").withColumn("offset", offset)
    return rows.select("seq_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), state).alias("path"))


def segmental_k_means(sequences: DataFrame, model: Hmm, max_iterations: int = 100) -> Training:
    """Even runs first, then counts and fits alternate with re-assignment by best paths until no step changes its
    state. A sequence without a possible path keeps its states. Works from a model without probabilities; the initial
    probabilities are divided by the number of sequences."""
    lists = float(sequences.count())
    if not lists:
        raise ValueError("there are no sequences")
    paths = even_paths(sequences, model.states)
    for _ in range(max_iterations):
        model = _maximise(_assigned(sequences, paths), model, lists)
        try:
            found = inference.viterbi(sequences, model).where(F.col("logp") > F.lit(-math.inf)).select("seq_id", F.col("path").alias("new"))
        except ValueError:
            break
        both = paths.join(found, "seq_id", "left").select("seq_id", F.coalesce("new", "path").alias("path"), (F.coalesce("new", "path") != F.col("path")).alias("moved"))
        both = _cut(both)  # the chain of joins would grow with the iterations
        paths = both.select("seq_id", "path")
        if not both.agg(F.max(F.col("moved").cast("int"))).first()[0]:
            return Training(model, (), True)
    return Training(model, (), False, True)


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage, written to the checkpoint folder: spark.checkpoint.dir, or in local mode (tests) a
    temporary one of our own; on a cluster without one this raises."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None and df.sparkSession.conf.get("spark.checkpoint.dir", None) is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="statelattice-"))
    return df.checkpoint()
