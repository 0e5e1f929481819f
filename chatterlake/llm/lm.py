"""Language-model scoring with a gated recurrent network in numpy.

Tokens are white-space words, A-Z in lower case, and one end token a text. All training tokens are counted on Spark.
The network reads and predicts symbols: the frequent words, and for all other words one of 64 shapes (a hash of the
word's last bytes), so it has a say on rare words too. Its output is factored: a class, then the symbol in its class.
A rare word's probability is its shape's, given the state, times its share among the training words of that shape.

Training is truncated backpropagation, state carried from window to window. Texts are dealt out in shards by a hash of text and
id, each of about TOKENS_A_SHARD tokens a round, so the model doesn't depend on how the input lies in files. In each round every
shard trains a copy of the model, and the copies are averaged by tokens. Each training text is learned whole, from its start to its end token, in the round that a hash of it picks; so the rounds together take every token
of every training text once. Given ``stretch``, each round takes that share of each text instead, from a place picked
by a hash. Scoring runs whole texts, with the state carried to the end.

The word table sent to tasks is bounded by ``HEAD`` words; counts of other words reach the texts by a shuffled join.

Defined results: null text is empty and has the end token only; a text without an id counts as training; rows with
equal ids each keep their row; an empty table gives an empty result; without training texts all counts are zero.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"

END = "\n"  # no word holds it
#: Words whose counts every task gets; words and shapes that the network tells apart; its classes, embedding and state.
HEAD, FREQUENT, SHAPES, CLASSES, EMBED, STATE = 150_000, 1000, 64, 32, 16, 24
SUFFIX_BYTES = 3
#: Steps of a window of training, texts trained side by side; characters of the texts scored side by side.
WINDOW, LANES, BATCH_CHARS = 32, 128, 8_000_000
RATE, CLIP = 0.08, 5.0
#: Training tokens of a shard in a round.
TOKENS_A_SHARD = 1_000_000
#: Predictions worked out together: so many fit a processor's cache.
ROWS_AT_ONCE = 8192
#: Logits are held within this, so that their exponentials stay finite.
LOGIT_LIMIT = 60.0
#: As an array, which numpy takes with less ado than a number.
HALF = np.array(0.5, np.float32)
#: The steps of a CRC-32, a byte each.
CRC_TABLE = np.array([crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def word_shape(word: bytes) -> int:
    return crc32(word[-SUFFIX_BYTES:]) % SHAPES


def word_shapes(words: pa.Array, at: np.ndarray) -> np.ndarray:
    """``word_shape`` of the words in some places of an Arrow array."""
    if not len(at):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset :]
    data = np.frombuffer(data or b"", np.uint8)
    ends = offsets[at + 1].astype(np.int64)
    sizes = ends - offsets[at]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for back in range(SUFFIX_BYTES, 0, -1):
        has = np.flatnonzero(sizes >= back)
        crc[has] = CRC_TABLE[(crc[has] ^ data[ends[has] - back]) & 0xFF] ^ (crc[has] >> 8)
    return (~crc % SHAPES).astype(np.int32)


def shape_column(word: Column) -> Column:
    data = word.cast("binary")
    return (F.crc32(F.substring(data, -SUFFIX_BYTES, SUFFIX_BYTES)) % SHAPES).cast("int")


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, the end token among them."""
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), f"[{BLANKS}]+"), "")
    return docs.select(F.explode(F.array_append(words, END)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@dataclass
class Vocabulary:
    """The head words with their counts, and what the network needs to know of all words."""

    index: pa.Array  # the words, in the places of the arrays below
    counts: np.ndarray
    symbols: np.ndarray
    tokens: int  # all training tokens
    words: int  # distinct ones
    shape_tokens: np.ndarray  # per shape, over words that aren't frequent
    shape_words: np.ndarray
    first_shape: int  # symbol of shape 0
    class_of: np.ndarray  # per symbol
    class_start: np.ndarray  # symbols of a class stand together
    end: int

    def shape_share(self) -> np.ndarray:
        """log10 of what the count of a word plus a half is divided by, per shape."""
        return np.log10(self.shape_tokens + 0.5 * (self.shape_words + 1))

    def base_share(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.words + 1))


def head_words(counts: DataFrame, head: int) -> list[tuple[str, int]]:
    """The most frequent words, at most ``head``, by count and word. A histogram of counts over a fixed number of steps
    gives the least count, so no task sends more than belongs to the head; words at the step that overflows stay out."""
    step = F.floor(F.log("n") * 64).cast("int")
    left, least = head, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    if least is None:
        return []
    found = counts.where(step >= least).toArrow()
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def make_vocabulary(counts: DataFrame, head: int = HEAD, frequent: int = FREQUENT) -> Vocabulary:
    """``counts``: a saved table (word, n)."""
    top = head_words(counts, head)
    end_count = next((n for w, n in top if w == END), 0)
    words = [(END, end_count), *((w, n) for w, n in top if w != END)]
    chosen = words[:frequent]
    names = [w for w, _ in chosen]
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    by_shape = {r["s"]: r for r in counts.groupBy(shape_column(F.col("word")).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tokens = np.array([by_shape[s]["n"] if s in by_shape else 0 for s in range(SHAPES)], dtype=float)
    kinds = np.array([by_shape[s]["v"] if s in by_shape else 0 for s in range(SHAPES)], dtype=float)
    for w, n in chosen:
        tokens[word_shape(w.encode())] -= n
        kinds[word_shape(w.encode())] -= n > 0
    symbols = len(chosen) + SHAPES
    class_of = np.sort(np.arange(symbols) * CLASSES // symbols)
    index = pa.array([w for w, _ in words], pa.string())
    of = np.array([i if i < len(chosen) else len(chosen) + word_shape(w.encode()) for i, (w, _) in enumerate(words)], dtype=np.int32)
    start = np.searchsorted(class_of, np.arange(CLASSES + 1))
    return Vocabulary(index, np.array([n for _, n in words], dtype=float), of, size["tokens"], size["words"], tokens, kinds, len(names), class_of, start, 0)


@dataclass
class Network:
    """Weights. A symbol's embedding is projected to what it adds to the update gate, the reset gate and the new state.

    Inside, states stand in columns, a lane each, so the gates of all lanes lie together. A gate is (1 + tanh) / 2.
    """

    embed: np.ndarray  # EMBED x symbols
    project: np.ndarray  # 3 STATE x EMBED
    back: np.ndarray  # 3 STATE x STATE
    to_class: np.ndarray  # STATE x CLASSES
    class_bias: np.ndarray
    to_symbol: np.ndarray  # symbols x STATE
    symbol_bias: np.ndarray

    @staticmethod
    def start(v: Vocabulary, seed: int = 7) -> Network:
        """Small random weights; biases at the symbols' training shares."""
        rng = np.random.default_rng(seed)
        symbols = len(v.class_of)
        n = np.concatenate([v.counts[: v.first_shape], v.shape_tokens]) + 0.5
        classes = np.bincount(v.class_of, weights=n, minlength=CLASSES) + 1e-6
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Network(
            draw(EMBED, symbols) * 3, draw(3 * STATE, EMBED) * 2, draw(3 * STATE, STATE) * 2, draw(STATE, CLASSES), np.log(classes / classes.sum()).astype(np.float32),
            draw(symbols, STATE), np.log(n / classes[v.class_of]).astype(np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Network:
        return self.over(flat.astype(np.float32))

    def over(self, flat: np.ndarray) -> Network:
        """A network of these shapes whose weights are views of ``flat``."""
        parts, at = [], 0
        for a in self.arrays():
            parts.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        return Network(*parts)

    @property
    def inputs(self) -> np.ndarray:
        """What each symbol adds, in rows."""
        return (self.project @ self.embed).T

    def advance(self, x: np.ndarray, h: np.ndarray, g: np.ndarray, gates: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
        """For columns of inputs and states: the recurrent parts, the gates, the candidates and the new states, each into
        the array given for it."""
        np.matmul(self.back, h, out=g)
        np.add(x[: 2 * STATE], g[: 2 * STATE], out=gates)
        np.tanh(gates, out=gates)
        np.multiply(gates, HALF, out=gates)
        np.add(gates, HALF, out=gates)
        np.multiply(gates[STATE:], g[2 * STATE :], out=new)
        np.add(new, x[2 * STATE :], out=new)
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        np.multiply(out, gates[:STATE], out=out)
        np.add(out, new, out=out)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """``advance`` for states in rows: the new states, gates, candidates and recurrent parts."""
        made = [np.empty((n * STATE, len(h)), np.float32) for n in (3, 2, 1, 1)]
        self.advance(x.T, h.T, *made)
        g, gates, new, out = made
        return out.T, gates.T, new.T, g[2 * STATE :].T

    def log_probs(self, v: Vocabulary, states: np.ndarray, targets: np.ndarray, grads: Network | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln p of each target, for states in rows; with ``grads``, puts the output weights' gradients there and gives
        that of the states. Biases go along as one more column of the weights, and ones as one of the states."""
        n, width = len(targets), int(np.diff(v.class_start).max())
        classes = v.class_of[targets].astype(np.uint8)
        order = np.argsort(classes, kind="stable")  # targets of a class stand together
        s = np.ones((n, STATE + 1), np.float32)
        s[:, :STATE] = states
        s, c, rows = s.take(order, axis=0), classes[order].astype(np.intp), np.arange(n)
        wanted = targets[order] - v.class_start[c]
        to_class = np.concatenate([self.to_class, self.class_bias[None]])
        to_symbol = np.concatenate([self.to_symbol, self.symbol_bias[:, None]], axis=1)
        found = np.flatnonzero(np.bincount(c, minlength=CLASSES))
        ends = np.searchsorted(c, np.arange(CLASSES + 1))
        parts = [(slice(ends[k], ends[k + 1]), slice(v.class_start[k], v.class_start[k + 1]), v.class_start[k + 1] - v.class_start[k]) for k in found]
        p, q = s @ to_class, np.zeros((n, width), np.float32)
        for at, symbols, size in parts:
            np.matmul(s[at], to_symbol[symbols].T, out=q[at, :size])
        np.clip(p, -LOGIT_LIMIT, LOGIT_LIMIT, out=p)
        np.clip(q, -LOGIT_LIMIT, LOGIT_LIMIT, out=q)
        for at, _, size in parts:
            q[at, size:] = -np.inf  # classes differ by a symbol
        logs = _softmax(p, rows, c, grads is not None)
        logs += _softmax(q, rows, wanted, grads is not None)
        d = None
        if grads is not None:
            by_class = s.T @ p
            grads.to_class[:], grads.class_bias[:] = by_class[:STATE], by_class[STATE]
            by_symbol = np.zeros_like(to_symbol)
            d = np.empty((n, STATE + 1), np.float32)
            for at, symbols, size in parts:
                np.matmul(q[at, :size].T, s[at], out=by_symbol[symbols])
                np.matmul(q[at, :size], to_symbol[symbols], out=d[at])
            grads.to_symbol[:], grads.symbol_bias[:] = by_symbol[:, :STATE], by_symbol[:, STATE]
            d += p @ to_class.T
        back = np.empty_like(order)
        back[order] = rows
        return logs.take(back), None if d is None else d.take(back, axis=0)[:, :STATE]


def _softmax(logits: np.ndarray, rows: np.ndarray, wanted: np.ndarray, slopes: bool) -> np.ndarray:
    """ln p of the wanted ones; leaves in place of the logits, if asked for, the slopes of -ln p. What is -inf has no share."""
    chosen = logits[rows, wanted]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    if slopes:
        logits *= (1 / total)[:, None]
        logits[rows, wanted] -= 1
    return chosen - np.log(total)


class Trainer:
    """Adagrad on windows of truncated backpropagation."""

    def __init__(self, net: Network, v: Vocabulary) -> None:
        self.net, self.v, self.weights = net, v, net.flat()
        for f, a in zip(fields(net), net.over(self.weights).arrays(), strict=True):  # all weights of the net are learned at once
            setattr(net, f.name, a)
        self.squares = np.full_like(self.weights, 1e-2)
        self.tokens = 0
        self.waiting: list[tuple[np.ndarray, int, np.ndarray]] = []  # what is left of a text, the symbol before it, the state there

    def window(self, symbols: np.ndarray, before: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Learn from symbols [steps, lanes], preceded by ``before``; takes and gives the states, in columns.

        A step does only what needs the step before it; all else is done for the whole window."""
        net, (steps, lanes) = self.net, symbols.shape
        prev = np.concatenate([before[None], symbols[:-1]])
        # time stands first, so what a step touches lies together
        h = np.empty((steps + 1, STATE, lanes), np.float32)
        rec, gates = np.empty((steps, 3 * STATE, lanes), np.float32), np.empty((steps, 2 * STATE, lanes), np.float32)
        new = np.empty((steps, STATE, lanes), np.float32)
        h[0] = state
        embedded = np.ascontiguousarray(net.embed.T).take(prev, axis=0)  # steps, lanes, EMBED
        x = np.matmul(net.project, embedded.transpose(0, 2, 1))
        for t in range(steps):
            net.advance(x[t], h[t], rec[t], gates[t], new[t], h[t + 1])
        gradients = np.zeros_like(self.weights)
        grads = net.over(gradients)
        _, d = net.log_probs(self.v, h[1:].transpose(0, 2, 1).reshape(-1, STATE), symbols.ravel(), grads)
        d = np.ascontiguousarray(d.reshape(steps, lanes, STATE).transpose(0, 2, 1))
        # what a state's gradient is multiplied by, to be that of: new state, update gate, reset gate, recurrent part of
        # the new state, state before
        slopes = np.empty((steps, 5, STATE, lanes), np.float32)
        z, r = gates[:, :STATE], gates[:, STATE:]
        keep = 1 - z
        np.multiply(new, new, out=slopes[:, 0])
        np.subtract(1, slopes[:, 0], out=slopes[:, 0])
        slopes[:, 0] *= keep
        np.multiply(slopes[:, 0], r, out=slopes[:, 3])
        np.subtract(1, r, out=slopes[:, 2])
        slopes[:, 2] *= slopes[:, 3]
        slopes[:, 2] *= rec[:, 2 * STATE :]
        slopes[:, 2] *= 2
        np.subtract(h[:-1], new, out=slopes[:, 1])
        slopes[:, 1] *= z
        slopes[:, 1] *= keep
        slopes[:, 1] *= 2
        slopes[:, 4] = z
        flat = slopes.reshape(steps, 5 * STATE, lanes)
        back = np.concatenate([net.back, np.eye(STATE, dtype=np.float32)]).T.copy()
        dh = np.zeros((STATE, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            np.add(dh, d[t], out=dh)
            np.multiply(slopes[t], dh, out=slopes[t])
            np.matmul(back, flat[t, STATE:], out=dh)
        project = np.concatenate([net.project[2 * STATE :], net.project[: 2 * STATE]])
        to_embed = np.matmul(flat[:, : 3 * STATE].transpose(0, 2, 1), project).reshape(-1, EMBED)
        by_input = np.matmul(flat[:, : 3 * STATE], embedded).sum(axis=0)
        grads.project[: 2 * STATE], grads.project[2 * STATE :] = by_input[STATE:], by_input[:STATE]
        grads.back[:] = np.matmul(flat[:, STATE : 4 * STATE], h[:-1].transpose(0, 2, 1)).sum(axis=0)
        order = np.argsort(prev.ravel().astype(np.int16), kind="stable")
        in_order = prev.ravel()[order]
        firsts = np.flatnonzero(np.diff(in_order, prepend=-1))
        grads.embed[:, in_order[firsts]] = np.add.reduceat(to_embed.take(order, axis=0), firsts, axis=0).T
        scale = 1 / lanes
        norm = math.sqrt(float(np.vdot(gradients, gradients))) * scale
        gradients *= scale * min(1.0, CLIP / (norm + 1e-9))
        self.squares += gradients * gradients
        gradients /= np.sqrt(self.squares)
        gradients *= RATE
        self.weights -= gradients
        self.tokens += symbols.size
        return h[-1]

    def learn(self, texts: list[np.ndarray], last: bool = True) -> None:
        """Learn from texts of symbols, LANES side by side; texts in a batch are cut to whole windows of the shortest
        and the rest of each goes on in later batches with the state it has reached. Unless these are the ``last``
        texts, what doesn't fill the lanes waits for more."""
        todo = self.waiting + [(t, self.v.end, np.zeros(STATE, np.float32)) for t in texts if len(t)]
        if not todo:
            return
        flat = np.concatenate([t for t, _, _ in todo])
        left = np.array([len(t) for t, _, _ in todo])
        at = np.cumsum(left) - left
        before, states = np.array([b for _, b, _ in todo]), np.stack([h for _, _, h in todo])
        order = np.argsort(-left, kind="stable")  # longest rest first
        while len(order) and (last or len(order) >= LANES):
            lanes, order = order[:LANES], order[LANES:]
            steps = min(WINDOW, left[lanes[-1]])
            symbols = flat[at[lanes] + np.arange(steps)[:, None]]
            states[lanes] = self.window(symbols, before[lanes], states[lanes].T).T
            before[lanes] = symbols[-1]
            at[lanes] += steps
            left[lanes] -= steps
            lanes = lanes[left[lanes] > 0]  # still in order: all have lost as much
            order = np.insert(order, np.searchsorted(-left[order], -left[lanes], side="right"), lanes)
        self.waiting = [(flat[at[i] : at[i] + left[i]].copy(), before[i], states[i].copy()) for i in order]


def score_texts(net: Network, v: Vocabulary, texts: list[np.ndarray]) -> np.ndarray:
    """ln p of each text of symbols, whole, with the state carried through all its windows."""
    order = np.argsort(-np.array([len(t) for t in texts], dtype=np.int64), kind="stable")
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    longest = int(lengths.max(initial=0))
    flat = np.concatenate([texts[i] for i in order]) if longest else np.zeros(0, np.int32)
    before = np.concatenate([[v.end], flat[:-1]]) if longest else flat
    offsets = np.cumsum(lengths) - lengths
    before[offsets[lengths > 0]] = v.end
    total = np.zeros(len(texts))
    embed = np.ascontiguousarray(net.embed.T)
    lives = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts that are longer than t
    reached = np.concatenate([[0], np.cumsum(lives)])
    h = np.zeros((STATE, len(texts)), np.float32)
    first = 0
    while first < longest:
        # steps whose inputs and predictions are worked out together
        end = max(first + 1, int(np.searchsorted(reached, reached[first] + ROWS_AT_ONCE, side="right")) - 1)
        times = np.repeat(np.arange(first, end), lives[first:end])
        edges = (reached[first : end + 1] - reached[first]).tolist()
        owners = np.arange(edges[-1]) - np.repeat(edges[:-1], lives[first:end])
        places = offsets[owners] + times
        embedded = embed.take(before[places], axis=0)
        states = np.empty((edges[-1], STATE), np.float32)
        live = 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a != live:
                live = b - a
                x, g, gates, new, out, spare = (np.empty((n * STATE, live), np.float32) for n in (3, 3, 2, 1, 1, 1))
                h = h[:, :live]
            np.matmul(net.project, embedded[a:b].T, out=x)
            net.advance(x, h, g, gates, new, out)
            states[a:b] = out.T
            h, out, spare = out, spare, out
        total += np.bincount(owners, weights=net.log_probs(v, states, flat[places])[0], minlength=len(texts))
        first = end
    out = np.zeros(len(texts))
    out[order] = total
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after another, and each text's number of words; null texts have none."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, edges = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
    some = pc.not_equal(pc.binary_length(words), 0)  # text may begin or end with blanks
    seen = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), np.diff(seen[edges])


def places_of(v: Vocabulary, words: pa.Array) -> np.ndarray:
    """Their places in the head table; -1 for words that aren't in it."""
    return pc.fill_null(pc.index_in(words, v.index), -1).to_numpy()


def symbols_of(v: Vocabulary, words: pa.Array, places: np.ndarray) -> np.ndarray:
    out = v.symbols[places]
    rare = np.flatnonzero(places < 0)
    out[rare] = v.first_shape + word_shapes(words, rare)
    return out


def with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of texts one after another, with ``end`` after each text; and where each text is over."""
    edges = np.cumsum(sizes + 1)
    out = np.full(edges[-1] if len(edges) else 0, end, values.dtype)
    inside = np.ones(len(out), bool)
    inside[edges - 1] = False
    out[inside] = values
    return out, edges


def symbol_texts(v: Vocabulary, texts: pa.Array) -> list[np.ndarray]:
    """The symbols of each text, the end token last."""
    words, sizes = words_of(texts)
    flat, edges = with_ends(symbols_of(v, words, places_of(v, words)), sizes, v.end)
    return np.split(flat, edges[:-1]) if len(edges) else []


def by_size(batches: Iterable[pa.Array], chars: int) -> Iterator[pa.Array]:
    """Texts in groups of about so many characters: a group is scored together."""
    group, size = [], 0
    for texts in batches:
        ends = size + np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy().astype(np.int64) + 1)
        while len(texts) and ends[-1] >= chars:
            full = int(np.searchsorted(ends, chars)) + 1
            yield pa.concat_arrays([*group, texts[:full]])
            texts, ends, group, size = texts[full:], ends[full:] - ends[full - 1], [], 0
        if len(texts):
            group, size = [*group, texts], int(ends[-1])
    if group:
        yield pa.concat_arrays(group)


def keep_large_arrays() -> None:
    """Where the C library lets us, freed arrays stay with the process: to map and unmap them for every window costs as
    much as the arithmetic."""
    try:
        tune = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    tune(-3, 1 << 30)  # M_MMAP_THRESHOLD
    tune(-1, 256 << 20)  # M_TRIM_THRESHOLD


def learned(v: Vocabulary, texts: pa.Array, k: int, stretch: float | None) -> list[np.ndarray]:
    """The symbols of each text to learn in a round: all, or a stretch from a place that a hash picks."""
    found = symbol_texts(v, texts)
    if stretch is None:
        return found
    out = []
    for text, symbols in zip(texts.to_pylist(), found, strict=True):
        size = min(len(symbols), max(WINDOW, math.ceil(len(symbols) * stretch)))
        at = crc32(f"{k} {text}".encode("utf-8", "replace")) % (len(symbols) - size + 1)
        out.append(symbols[at : at + size])
    return out


def train(docs: DataFrame, v: Vocabulary, text_col: str, rounds: int, stretch: float | None, id_col: str | None = None) -> tuple[Network, int]:
    """The averaged network after ``rounds`` that take each text whole once, or a stretch of each every time; and the
    number of tokens it was shown. Every shard trains a copy, on its texts in the order of their hashes, and
    the copies are added up on the executors: what reaches the driver is one sum for each weight."""
    spark = docs.sparkSession
    net = Network.start(v)
    shards = max(1, math.ceil(v.tokens / (TOKENS_A_SHARD * (rounds if stretch is None else 1))))
    key = F.xxhash64(F.lit("shard"), "text", "id")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(id_col).cast("string") if id_col else F.lit("")).alias("id"))
    rows = rows.select("text", key.alias("key"), F.pmod(key, F.lit(shards)).alias("shard"))
    vocabulary = spark.sparkContext.broadcast(v)
    shown = 0
    for k in range(rounds):
        weights = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], k=k, weights=weights) -> Iterator[pa.RecordBatch]:
            keep_large_arrays()
            words, trainer, shard = vocabulary.value, None, None

            def done(trainer: Trainer | None) -> Iterator[pa.RecordBatch]:
                if trainer:
                    trainer.learn([])
                    if trainer.tokens:
                        yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens], pa.int64()), pa.array([trainer.weights], pa.list_(pa.float32()))], names=["tokens", "weights"])

            for batch in batches:
                shards = batch["shard"].to_numpy()
                firsts = np.flatnonzero(np.diff(shards, prepend=-1))  # a shard's rows come one after another
                for a, b in zip(firsts, [*firsts[1:], len(shards)], strict=True):
                    if shards[a] != shard:
                        yield from done(trainer)
                        trainer, shard = Trainer(weights.value.like(weights.value.flat()), words), shards[a]
                    trainer.learn(learned(words, batch["text"][a:b], k, stretch), last=False)
            yield from done(trainer)

        mine = rows if stretch is not None else rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        mine = mine.repartition("shard").sortWithinPartitions("shard", "key").select("text", "shard")
        copies = saved(mine.mapInArrow(run, "tokens long, weights array<float>"), "network-copies")
        tokens = copies.agg(F.sum("tokens")).first()[0]
        if tokens:
            # decimals, so the sum is the same in whatever order it is made
            each = copies.select("tokens", F.posexplode("weights").alias("place", "weight"))
            part = (F.col("weight").cast("double") * F.col("tokens")).cast("decimal(28,6)")
            total = each.groupBy("place").agg(F.sum(part).cast("double").alias("total")).toPandas().sort_values("place")
            net = net.like(total["total"].to_numpy() / tokens)
            shown += tokens
    return net, shown


def text_scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, stretch: float | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns where ``held`` is false."""
    spark = docs.sparkSession
    training = docs.where(~held)
    counts = saved(word_counts(training, text_col), "word-counts")
    v = make_vocabulary(counts)
    vocabulary = spark.sparkContext.broadcast(v)
    network = spark.sparkContext.broadcast(train(training, v, text_col, rounds, stretch, id_col)[0])

    @F.arrow_udf("n_tokens long, n_known long, base double, words array<string>, times array<long>, score double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_large_arrays()
        v, net = vocabulary.value, network.value
        # what a word adds, by its place; the last one stands for words that aren't in the head table
        rare, shares = v.symbols >= v.first_shape, v.shape_share()
        seen, logs = np.append(v.counts > 0, False), np.append(np.log10(v.counts + 0.5), 0.0)
        inside = np.append(np.where(rare, logs[:-1] - shares[np.where(rare, v.symbols - v.first_shape, 0)], 0.0), 0.0)
        for group in by_size(batches, BATCH_CHARS):
            words, sizes = words_of(group)
            places = places_of(v, words)
            symbols, edges = with_ends(symbols_of(v, words, places), sizes, v.end)
            firsts = edges - sizes - 1
            ended = with_ends(places, sizes, v.end)[0]
            tail = np.flatnonzero(places < 0)
            owners = np.repeat(np.arange(len(group)), sizes)[tail]
            score = score_texts(net, v, np.split(symbols, edges[:-1])) / math.log(10) + np.add.reduceat(inside[ended], firsts)
            score -= np.bincount(owners, weights=shares[symbols[tail + owners] - v.first_shape], minlength=len(group))
            # each word once a text
            names = words.take(pa.array(tail)).dictionary_encode()
            kinds = max(1, len(names.dictionary))
            once, times = np.unique(owners * kinds + names.indices.to_numpy(), return_counts=True)
            lists = pa.array(np.searchsorted(once, np.arange(len(group) + 1) * kinds), pa.int32())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes + 1, pa.int64()), pa.array(np.add.reduceat(seen[ended].astype(np.int64), firsts)),
                    pa.array(np.add.reduceat(logs[ended], firsts) - (sizes + 1) * v.base_share()),
                    pa.ListArray.from_arrays(lists, names.dictionary.take(pa.array(once % kinds))), pa.ListArray.from_arrays(lists, pa.array(times, pa.int64())), pa.array(score),
                ],
                names=["n_tokens", "n_known", "base", "words", "times", "score"],
            )

    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), scored(F.col(text_col)).alias("scored")).select("id", "held_out", "scored.*")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "head-scores")
    tail = rows.select("row", F.inline(F.arrays_zip("words", "times")).alias("word", "times"))
    tail = tail.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("tail"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    out = rows.drop("words", "times").join(tail, "row", "left")
    more = F.coalesce("tail", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
