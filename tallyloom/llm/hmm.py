"""Log-likelihoods of texts under a hidden Markov language model.

Every token is emitted by a hidden state; states follow each other as a Markov chain. Baum-Welch
trains them: each task runs the scaled forward and backward recursions over its texts and sums the
expected counts, Spark adds the sums of all tasks, and a round of the new parameters goes to the
next tasks. Scores are exact: the scaled forward recursion over the whole text.

Counts of all words of all training texts are gathered first. Words that stand often emit by
themselves: at most ``HEAD`` words of at most ``HEAD_BYTES`` bytes and at least ``LEAST`` tokens,
chosen by a histogram of counts, which bounds what every task is sent. All others, however many
they are, are emitted in two steps: the state emits the word's ending (``CLASSES`` of them by a
hash), the ending emits the word by its own count. So the recursion needs the bounded tables
only, and the second step, like the base score, is a sum over words that a join with the counts
gives. Per ending, ``DISCOUNT`` of a token of every word's count is left to words that training
texts don't hold; these are one event of their ending.

The emission of a word by a state leans to the word's share of all tokens by ``LEAN`` tokens, so a
word seen in one state only can come from any. Every one of the ``ROUNDS`` of Baum-Welch takes all
training texts; their symbols, two bytes a token, are written once and read in each round.

Defined results: a null text is empty, and an empty one is its end token alone; every input row
gives one row; rows that repeat an id or a text count each, in training as well; a null id is not
held out; without training texts every word is unknown and all states are alike; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed_join, named, small_batches, tidy

STATES = 16
HEAD, HEAD_BYTES, LEAST = 64_000, 64, 5
CLASSES, ENDING = 1_024, 3  # with HEAD under 2**16, so that symbols sort as 16-bit numbers
LEAN, DISCOUNT = 2.0, 0.5
#: Rounds of Baum-Welch.
ROUNDS = 6
SEED = 11
#: Tokens of a batch of the recursions, and the most of a sequence in training: longer texts go on as a next sequence.
TOKENS, SEGMENT = 800_000, 2_048
#: Tokens of training texts that a task holds to put them in order of length.
POOL = 4_000_000
#: Tokens of scores between two rescalings: each leaves at least 1e-20 of what it finds, far within a double.
RESCALE = 8
#: The same of expected counts, in single precision: each token leaves at least 1e-10 of what it finds.
APART = 2
#: Bytes of texts that a task counts before it passes the counts on.
PASS_ON = 16 << 20
#: Expected counts are added up in whole parts of a token, so that their sums don't depend on the order.
PARTS = 1 << 16
#: The end token, first of the head; no word holds a space.
END = " "


def endings(words: pa.Array) -> np.ndarray:
    """Classes of the last ``ENDING`` bytes of words."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(1, np.uint8)
    h = np.zeros(len(words), np.int64)
    for back in range(ENDING, 0, -1):
        at = offsets[1:] - back
        h = h * 257 + np.where(at >= offsets[:-1], data[np.maximum(at, 0)], 0)
    return ((h * 2_654_435_761 & 0xFFFFFFFF) * CLASSES >> 32).astype(np.int32)


class Tokens:
    """Words of texts, between ASCII white space and with A-Z in lower case; ``doc`` says whose each one is."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        doc, words = pc.list_parent_indices(split), split.flatten()
        there = pc.greater(pc.binary_length(words), 0)
        self.words, self.doc, self.n = words.filter(there), doc.filter(there).to_numpy(zero_copy_only=False), len(texts)

    def symbols(self, head: pa.Array) -> np.ndarray:
        """The head's words by their place, others by their ending behind it."""
        found = pc.fill_null(pc.index_in(self.words, head), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = np.flatnonzero(found < 0)
        found[rare] = len(head) + endings(self.words.take(pa.array(rare)))
        return found

    def sequences(self, symbols: np.ndarray) -> list[np.ndarray]:
        """Each text's symbols and the end token's, which is 0."""
        x = np.zeros(len(symbols) + self.n, np.uint16)
        x[np.arange(len(symbols)) + self.doc] = symbols
        return np.split(x, np.cumsum(np.bincount(self.doc, minlength=self.n) + 1)[:-1]) if self.n else []

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, of_words, self.n)


class Model:
    """Start, step and emission probabilities; columns of ``emit`` are states, rows the head's words and then the endings."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    def single(self) -> Model:
        """In single precision and each symbol's emissions over their mean, which expected counts don't depend on; scores take double precision."""
        emit = self.emit / self.emit.mean(1, keepdims=True)
        return Model(*(x.astype(np.float32) for x in (self.start, self.step, emit)))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Of each symbol, a row for each state."""
        return np.ascontiguousarray(self.emit.T).take(x, axis=1, mode="clip")

    @classmethod
    def first(cls, count: np.ndarray, states: int, seed: int = SEED) -> Model:
        """States that stay for long and whose emissions lean at random from the symbols' shares."""
        rng = np.random.default_rng(seed)
        emit = count[:, None] * np.exp(0.5 * rng.standard_normal((len(count), states)))
        step = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(0))

    @classmethod
    def fitted(cls, starts: np.ndarray, steps: np.ndarray, emitted: np.ndarray, count: np.ndarray) -> Model:
        """From expected counts; ``count`` has each symbol's own count, above zero."""
        pull = LEAN / (emitted.sum(1, keepdims=True) + LEAN)
        share = count[:, None] / count.sum() * np.maximum(emitted.sum(0), 1e-3)
        emit = (1 - pull) * emitted + pull * share
        starts, steps = starts + 1 / len(starts), steps + 1 / len(starts)
        return cls(starts / starts.sum(), steps / steps.sum(1, keepdims=True), emit / emit.sum(0))


class Ordered:
    """Sequences laid out by position: all first tokens, then all second ones, the longest sequence first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.rank = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in self.rank])
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        self.x = np.empty(int(self.offset[-1]), np.uint16)
        for r, i in enumerate(self.rank):
            self.x[self.offset[: lengths[r]] + r] = sequences[i]

    def places(self) -> np.ndarray:
        """Of each token, the place of its sequence in ``rank``."""
        return np.arange(len(self.x)) - np.repeat(self.offset[:-1], self.active)


def forward(model: Model, seq: Ordered, emitted: np.ndarray, alpha: np.ndarray, every: int = 1) -> np.ndarray:
    """The scale of each token; fills ``alpha``, which may be ``emitted`` itself, with the scaled forward variables.

    Both have a row for each state, so that every operation runs along the tokens of a position.
    Variables are rescaled at each ``every``-th position and the last one of a sequence; in between scales are 1.
    """
    scale = np.ones(len(seq.x), emitted.dtype)
    back, now = np.ascontiguousarray(model.step.T), model.start[:, None]
    active, ahead = seq.active.tolist(), [*seq.active[1:].tolist(), 0]
    for t, (o, n) in enumerate(zip(seq.offset.tolist(), active)):
        now = np.multiply(back @ now[:, :n] if t else now, emitted[:, o : o + n], out=alpha[:, o : o + n])
        if t % every == every - 1 or n != ahead[t]:
            now /= now.sum(0, out=scale[o : o + n])
    return scale


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability."""
    seq = Ordered(sequences)
    emitted = model.emissions(seq.x)
    scale = np.log10(forward(model, seq, emitted, emitted, RESCALE))
    out = np.empty(len(sequences))
    out[seq.rank] = np.bincount(seq.places(), scale, len(sequences))
    return out


class Expected:
    """Expected counts of a task: starts, steps and emissions."""

    def __init__(self, symbols: int, states: int):
        self.starts, self.steps, self.emitted = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))

    def add(self, model: Model, sequences: list[np.ndarray]) -> None:
        seq = Ordered(sequences)
        if not len(seq.x):
            return
        emitted = model.emissions(seq.x)
        alpha, beta = np.empty_like(emitted), np.ones_like(emitted)
        # from here on, emissions over scales, then the backward variables times them
        emitted /= forward(model, seq, emitted, alpha, APART)
        behind, step, steps = emitted[:, :0], model.step, np.zeros_like(model.step)
        offset, active = seq.offset.tolist(), seq.active.tolist()
        for t in range(len(active) - 1, -1, -1):
            o, n = offset[t], behind.shape[1]
            if n:
                np.matmul(step, behind, out=beta[:, o : o + n])
                steps += alpha[:, o : o + n] @ behind.T
            behind = emitted[:, o : o + active[t]]
            behind *= beta[:, o : o + active[t]]
        self.steps += step * steps
        gamma = np.multiply(alpha, beta, out=alpha)
        self.starts += gamma[:, : active[0]].sum(1)
        for i, g in enumerate(gamma):
            self.emitted[:, i] += np.bincount(seq.x, g, len(self.emitted))


def batches(sequences: Iterable[np.ndarray], most: int = TOKENS) -> Iterator[list[np.ndarray]]:
    """Sequences together while they have ``most`` tokens at most; a longer one is alone."""
    together: list[np.ndarray] = []
    size = 0
    for s in sequences:
        if together and size + len(s) > most:
            yield together
            together, size = [], 0
        together.append(s)
        size += len(s)
    if together:
        yield together


def word_counts(documents: DataFrame, text: Column, held: Column) -> DataFrame:
    """(w, g, n, m): each token, its ending's class, its count in training texts and in all."""

    def counted(texts: pa.Array, trains: bool) -> pa.RecordBatch:
        words, n = Tokens(texts).words.value_counts().flatten() if len(texts) else (pa.array([], pa.string()), pa.array([], pa.int64()))
        words, n = pa.concat_arrays([words, pa.array([END])]), np.append(n.to_numpy(zero_copy_only=False), len(texts))
        return pa.RecordBatch.from_arrays([words, pa.array(endings(words)), pa.array(n if trains else 0 * n), pa.array(n)], ["w", "g", "n", "m"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def all_counted() -> Iterator[pa.RecordBatch]:
            together = pa.Table.from_batches(waiting).combine_chunks()
            for trains in (True, False):
                yield counted(pa.concat_arrays([pa.array([], pa.string()), *together.filter(pc.equal(together["h"], not trains))["t"].chunks]), trains)
            waiting.clear()

        for batch in rows:
            waiting.append(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1)], ["t", "h"]))
            if sum(b.nbytes for b in waiting) > PASS_ON:
                yield from all_counted()
        if waiting:
            yield from all_counted()

    found = documents.select(text.alias("t"), held.alias("h")).mapInArrow(tidy(run), "w string, g int, n bigint, m bigint")
    return found.groupBy("w", "g").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def most_frequent(counts: DataFrame, head: int) -> Column:
    """Where a word is one of the head: no more than ``head`` words, all those of a count or none."""
    step = F.floor(8 * F.log2("n"))
    fit = (F.col("n") >= LEAST) & (F.octet_length("w") <= HEAD_BYTES)
    so_far, least = 0, None
    for r in counts.filter(fit).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 504 at most
        so_far += r["count"]
        if so_far > head:
            break
        least = r.step
    return fit & (step >= least) if least is not None else F.lit(False)


def trained(documents: DataFrame, text: Column, held: Column, words, count: np.ndarray, states: int) -> Model:
    """Baum-Welch over all training texts in every round; ``words`` is the broadcast head."""
    context = documents.sparkSession.sparkContext
    names = [f"s{i}" for i in range(states)]
    symbols = len(count)

    def coded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.array(words.value, pa.string())
        for batch in rows:
            texts = Tokens(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in texts.sequences(texts.symbols(head))], pa.binary())], ["x"])

    taken = cut(documents.filter(~held).select(text.alias("t")).mapInArrow(tidy(coded), "x binary"))
    model = Model.first(count, states)
    for _ in range(ROUNDS):
        sent = context.broadcast(model)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, found = sent.value.single(), Expected(symbols, states)

            def sequences() -> Iterator[np.ndarray]:
                for batch in rows:
                    for x in batch.column(0):
                        x = np.frombuffer(x.as_py(), np.uint16)
                        yield from (x[lo : lo + SEGMENT] for lo in range(0, len(x), SEGMENT))

            # those of about one length together, so that positions have many tokens
            ordered = (x for pool in batches(sequences(), POOL) for x in sorted(pool, key=len))
            for together in batches(ordered, TOKENS // 2):
                found.add(now, together)
            # symbols, then the start, then the steps from each state
            table = np.rint(np.concatenate((found.emitted, found.starts[None], found.steps)) * PARTS).astype(np.int64)
            there = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(table[there, i]) for i in range(states))], ["symbol", *names])

        sums = taken.mapInArrow(tidy(run), f"symbol int, {', '.join(f'{c} bigint' for c in names)}").groupBy("symbol").agg(*(F.sum(c).alias(c) for c in names))
        got = sums.toPandas()  # HEAD + CLASSES + states + 1 rows at most
        table = np.zeros((symbols + states + 1, states))
        table[got["symbol"].to_numpy(int)] = got[names].to_numpy(float) / PARTS
        model = Model.fitted(table[symbols], table[symbols + 1 :], table[:symbols], count)
        sent.unpersist()
    return model


def scores(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held: Column | None = None,
    states: int = STATES,
    head: int = HEAD,
) -> DataFrame:
    """A row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` says which rows teach nothing; by default those whose id's checksum leaves 1 modulo 5.
    base_score and score are log10 probabilities of the text under the shares of its tokens and
    under the model. Defined results for odd rows are in the module's text.
    """
    small_batches(documents)
    key, text = named([id_col, text_col])
    held = F.coalesce(held if held is not None else F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))
    counts = cut(word_counts(documents, text, held))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    bottom = total + 0.5 * (distinct + 1)
    # the end token is the first of the head, however often it stands
    frequent = F.coalesce((F.col("w") == END) | most_frequent(counts.filter(F.col("w") != END), head - 1), F.lit(False))
    chosen = counts.filter(frequent).select("w", "n").toPandas()  # ``head`` rows at most
    chosen = {END: 0} | dict(sorted(zip(chosen["w"], chosen["n"]), key=lambda c: (c[0] != END, -c[1], c[0])))
    n_g, v_g = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.filter(~frequent & (F.col("n") > 0)).groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # CLASSES at most
        n_g[r.g], v_g[r.g] = r.n, r.v
    context = documents.sparkSession.sparkContext
    own = np.array(list(chosen.values()), float)
    words = context.broadcast(list(chosen))
    model = trained(documents, text, held, words, np.concatenate((np.maximum(own, 0.5), n_g + 0.5)), states)
    sent = context.broadcast(model)
    size = len(own)
    base_of = np.concatenate((np.log10((own + 0.5) / bottom), np.zeros(CLASSES)))
    second = -np.log10(n_g + 1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head_words = sent.value, pa.array(words.value, pa.string())
        waiting: list[pa.RecordBatch] = []
        coded: list[np.ndarray] = []

        def scored() -> Iterator[pa.RecordBatch]:
            hmm = np.array([y for together in batches(coded) for y in log_likelihoods(now, together)])
            coded.clear()
            while waiting:
                b = waiting.pop(0)
                later, hmm = hmm[: len(b)] + b.column(5).to_numpy(), hmm[len(b) :]
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(later), b.column(6)], names)

        for batch in rows:
            texts = Tokens(batch.column(2))
            x = texts.symbols(head_words)
            rare = np.flatnonzero(x >= size)
            listed = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(texts.doc[rare], minlength=texts.n))).astype(np.int32), texts.words.take(pa.array(rare)))
            sums = texts.sums(np.ones(len(x))).astype(np.int64), texts.sums(x < size).astype(np.int64), texts.sums(base_of[x]) + base_of[0], texts.sums(second[np.maximum(x - size, 0)] * (x >= size))
            columns = [pa.array(sums[0] + 1), pa.array(sums[1] + int(own[0] > 0)), pa.array(sums[2]), pa.array(sums[3]), pc.binary_join(listed, " ")]
            waiting.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names))
            coded += texts.sequences(x)
            if sum(map(len, coded)) >= TOKENS:
                yield from scored()
        yield from scored()

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "hmm", "rare"]
    scored = documents.select(key.alias("doc_id"), held.alias("held_out"), text.alias("t"))
    scored = cut(scored.mapInArrow(tidy(run), f"doc_id {scored.dtypes[0][1]}, held_out boolean, n_tokens bigint, n_known bigint, base double, hmm double, rare string"))
    # what is cut has its rows in place for good, so a number of a row stays its own
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    spelt = scored.filter(F.col("rare") != "").select("row", F.explode(F.split("rare", " ")).alias("w"))
    c = F.col("n").cast("double")
    left = F.element_at(F.array(*(F.lit(float(v)) for v in DISCOUNT * v_g + 1)), F.col("g") + 1)
    alone = counts.filter(~frequent).select(
        "w", (F.col("n") > 0).cast("bigint").alias("known"), F.log10((c + 0.5) / F.lit(bottom)).alias("b"), F.log10(F.when(c > 0, c - DISCOUNT).otherwise(left)).alias("l")
    )
    sums = keyed_join(spelt, alone, "w", counts.filter(~frequent), "m").groupBy("row").agg(*(F.sum(c).alias(c) for c in ("known", "b", "l")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("hmm") + zero("l")).alias("score"),
    )
