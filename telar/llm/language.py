"""Language of documents and of the runs of mixed ones, by cross-parsing entropy.

A suffix automaton of labelled text per language gives, at each character of a text, the length of the longest match
that ends there. Parsed greedily from the right into such matches, a text needs few phrases in its own language and
many in others; a phrase costs the logarithm of the language's text length. The cost is shared out over the words,
and the cheapest sequence of languages, with a price on each change, gives the runs.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOT_LETTER = re.compile(r"[^\w]+|_+")
_SPACELESS = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
_DIGITS = re.compile(r"\d+")


def plain(text: str) -> str:
    """Lower-case words in single spaces, a space at both ends; figures become 0. Empty if there is no word.

    In scripts without spaces every character is a word.
    """
    while "&" in text and (resolved := html.unescape(text)) != text:
        text = resolved
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = _SPACELESS.sub(r" \g<0> ", text)
    text = _DIGITS.sub("0", _NOT_LETTER.sub(" ", text.lower())).strip()
    return f" {text} " if text else ""


class SuffixAutomaton:
    """Of one sequence; ``next``, ``link`` and ``length`` by state, state 0 the empty match."""

    def __init__(self, text: Iterable):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def table(self, width: int, bits: int) -> np.ndarray:
        """[state, character number] → next state << ``bits`` | the most a match can be long after it, failures resolved."""
        n, most = len(self.next), (1 << bits) - 1
        out = np.zeros((n, width), np.int64)
        length = np.array(self.length)
        for s in np.argsort(length, kind="stable"):
            if s:
                parent = self.link[s]
                out[s] = out[parent]
            for c, target in self.next[s].items():
                if c > 0:
                    # Seen from here a match grows by one; seen from a longer state that fails, it is cut to this length.
                    out[s, c] = (target << bits) | min(self.length[s] + 1, most)
        return out


#: Characters with a number of their own; rarer ones of the training text share OTHERS numbers by their code point, so
#: that the tables of languages with thousands of characters stay bounded.
OWN, OTHERS = 192, 64


def character_codes(texts: list[str]) -> dict[str, int]:
    """A number from 1 for each character but the line end."""
    counts = Counter("".join(texts))
    counts.pop("\n", None)
    ranked = sorted(counts, key=lambda c: (-counts[c], c))
    return {c: i for i, c in enumerate(ranked[:OWN], 1)} | {c: OWN + 1 + ord(c) % OTHERS for c in ranked[OWN:]}


@dataclass
class Model:
    languages: list[str]
    codes: dict[str, int]
    roots: np.ndarray
    table: np.ndarray
    bits: np.ndarray
    change_bits: float
    length_bits: int

    @classmethod
    def train(cls, texts: dict[str, str], change_bits: float = 40.0) -> Model:
        """One automaton per language of its plain texts, joined by line ends that no query contains.

        A match is at most as long as the longest line; states and lengths share an integer as wide as they need.
        """
        languages = sorted(texts)
        codes = character_codes(list(texts.values()))
        width = max(codes.values(), default=0) + 1
        longest = max((len(line) for t in texts.values() for line in t.split("\n")), default=1)
        length_bits = (longest + 1).bit_length()
        automata = [SuffixAutomaton(codes.get(c, -1) for c in texts[x]) for x in languages]
        kind = np.int32 if sum(len(a.next) for a in automata) << length_bits < 1 << 31 else np.int64
        tables, roots, offset = [], [], 0
        for automaton in automata:
            t = automaton.table(width, length_bits)
            roots.append(offset)
            tables.append((t + (offset << length_bits)).astype(kind))
            offset += len(t)
        table = np.concatenate(tables) if tables else np.zeros((1, 1), kind)
        bits = np.array([math.log2(max(len(texts[x]), 2)) for x in languages])
        return cls(languages, codes, np.array(roots, np.int64), table, bits, change_bits, length_bits)

    def matches(self, codes: np.ndarray) -> np.ndarray:
        """[language, text, position] length of the longest match that ends there."""
        flat, width = self.table.reshape(-1), self.table.shape[1]
        n, size = codes.shape
        out = np.zeros((len(self.languages), n, size), np.min_scalar_type((1 << self.length_bits) - 1))
        state = np.repeat(self.roots[:, None], n, 1).astype(np.int64)
        length, most = np.zeros_like(state), (1 << self.length_bits) - 1
        for i in range(size):
            found = flat[state * width + codes[:, i]]
            state = (found >> self.length_bits).astype(np.int64)
            length = np.minimum(length + 1, found & most)
            out[:, :, i] = length
        return out

    def costs(self, longest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[language, text, position] bits up to and including the position, of the greedy parse from the right."""
        k, n, size = longest.shape
        steps = np.zeros((k, n, size + 1), np.float32)
        flat_steps, flat_longest = steps.reshape(-1), longest.reshape(-1)
        lane = np.arange(k * n)
        at = np.tile(sizes - 1, k)
        bits = np.repeat(self.bits, n)
        live = at >= 0
        lane, at, bits = lane[live], at[live], bits[live]
        while len(lane):
            m = flat_longest[lane * size + at].astype(np.int64)
            cost = np.where(m > 0, bits, bits + 8)
            m = np.maximum(m, 1)
            first = lane * (size + 1) + at - m + 1
            flat_steps[first] += cost / m
            flat_steps[first + m] -= cost / m
            at = at - m
            live = at >= 0
            lane, at, bits = lane[live], at[live], bits[live]
        return np.cumsum(np.cumsum(steps[:, :, :size], axis=2), axis=2)

    def runs(self, texts: list[str]) -> list[list[tuple[str, float, str]]]:
        """Per plain text its runs in order: language, confidence, text."""
        out: list[list[tuple[str, float, str]]] = [[] for _ in texts]
        if not self.languages:
            return out
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(texts[order[end]]) <= 400_000:
                end += 1
            batch = order[at:end]
            for i, r in zip(batch, self._batch([texts[i] for i in batch])):
                out[i] = r
            at = end
        return out

    def _batch(self, texts: list[str]) -> list[list[tuple[str, float, str]]]:
        n, sizes = len(texts), np.array([len(t) for t in texts])
        size = int(sizes.max())
        lookup = np.zeros(0x110000 if max(map(max, texts)) > "￿" else 0x10000, np.uint16)
        for c, i in self.codes.items():
            if ord(c) < len(lookup):
                lookup[ord(c)] = i
        points = np.frombuffer("".join(t.ljust(size, "\n") for t in texts).encode("utf-32-le"), np.uint32).reshape(n, size)
        codes = lookup[points]
        longest = self.matches(codes)
        cost = self.costs(longest, sizes)
        rows, spots = np.nonzero(points == 32)
        n_spaces = np.bincount(rows, minlength=n)
        words = int(n_spaces.max()) - 1
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n_spaces) - n_spaces, n_spaces)
        space = np.zeros((n, words + 1), np.int64)
        space[rows, nth] = spots
        real = np.arange(words)[None, :] < (n_spaces - 1)[:, None]
        start, stop = space[:, :-1], np.where(real, space[:, 1:], 0)
        text = np.arange(n)[:, None]
        spent = np.moveaxis(cost[:, text, stop] - cost[:, text, np.where(real, start, 0)], 0, 2)
        # A word that no language's text has whole is a name or a misspelling: it says nothing about the language.
        whole = (longest[:, text, stop] >= (stop - start + 1)[None]).any(0) & real
        spent = np.where(whole[:, :, None], spent, 0.0)
        path = self._path(spent)
        totals = np.concatenate([np.zeros((n, 1, spent.shape[2])), np.cumsum(spent, axis=1)], axis=1)
        result = []
        for t in range(n):
            w = int(n_spaces[t]) - 1
            p = path[t, :w]
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), w]
            runs = []
            for a, b in zip(cuts, cuts[1:]):
                bits = totals[t, b] - totals[t, a]
                odds = np.exp2(-(bits - bits.min()) / 8)
                runs.append((self.languages[p[a]], float(odds[p[a]] / odds.sum()), texts[t][space[t, a] + 1 : space[t, b]]))
            result.append(runs)
        return result

    def _path(self, spent: np.ndarray) -> np.ndarray:
        """[text, word] the language of each word on the cheapest path."""
        n, words, k = spent.shape
        back = np.zeros((n, words, k), np.int8)
        best = np.zeros((n, k))
        for w in range(words):
            if w:
                source = best.argmin(1)
                turn = best[np.arange(n), source] + self.change_bits
                changed = turn[:, None] < best
                back[:, w] = np.where(changed, source[:, None], np.arange(k)[None])
                best = np.where(changed, turn[:, None], best)
            best = best + spent[:, w]
        path = np.zeros((n, words), np.int8)
        now = best.argmin(1)
        for w in range(words - 1, -1, -1):
            path[:, w] = now
            now = back[np.arange(n), w, now]
        return path


def clean_sample(rows: list[tuple[str, str]], rounds: int = 3, window: int = 6, margin: float = 6.0) -> dict[str, list[str]]:
    """Plain texts per language of a labelled sample, wrong labels mended and mixed texts left out.

    Word counts per label say which language each text is most like; the counts are taken again from that. A text with
    a window of words that is clearly more like another language is left out.
    """
    texts = list(dict.fromkeys((p, label) for t, label in rows if (p := plain(t))))
    labels = sorted({label for _, label in texts})
    if not labels:
        return {}
    split = [t.split() for t, _ in texts]
    common = {w: i for i, w in enumerate(sorted(w for w, c in Counter(w for s in split for w in set(s)).items() if c >= 3))}
    ids = [np.array([common[w] for w in s if w in common], np.int64) for s in split]
    guess = np.array([labels.index(label) for _, label in texts])
    weights = np.zeros((max(len(common), 1), len(labels)))
    for _ in range(rounds):
        counts = np.full((max(len(common), 1), len(labels)), 0.2)
        for words, g in zip(ids, guess):
            np.add.at(counts, (words, g), 1)
        weights = np.log(counts / counts.sum(0))
        guess = np.array([weights[w].sum(0).argmax() if len(w) else g for w, g in zip(ids, guess)])
    out: dict[str, list[str]] = {label: [] for label in labels}
    for (text, _), words, g in zip(texts, ids, guess):
        score = weights[words]
        if len(words) > window:
            sums = np.concatenate([np.zeros((1, len(labels))), score.cumsum(0)])
            near = sums[window:] - sums[:-window]
            if (near.max(1) - near[:, g] > margin).any():
                continue
        out[labels[g]].append(text)
    return {label: list(dict.fromkeys(found)) for label, found in out.items() if found}


def fit(labelled: DataFrame, text: str, language: str, rows_per_language: int = 1000, chars_per_language: int = 24_000, change_bits: float = 40.0) -> Model:
    """A model from a bounded sample: per language the ``rows_per_language`` texts of smallest hash.

    Rows without text or language are left out. A text that doesn't fit into what is left of ``chars_per_language`` is
    passed over for the next; where none fits, the shortest is cut to it, so that no language of the sample is missing. Only
    the sample comes to the driver, and the model's size is bounded by ``chars_per_language``: at most two states per
    character.
    """
    order = Window.partitionBy("language").orderBy("h", "text")
    sample = (
        labelled.select(F.col(text).alias("text"), F.col(language).alias("language")).where("text is not null and language is not null")
        .withColumn("h", F.xxhash64("text")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language)
        .select("text", "language").collect()
    )
    chosen = {}
    for label, texts in clean_sample(sorted((r.text, r.language) for r in sample)).items():
        joined, used = [], 0
        for t in sorted(texts, key=lambda x: hash_of(x)):
            if used + len(t) > chars_per_language:
                continue
            joined.append(t)
            used += len(t) + 1
        chosen[label] = "\n".join(joined) if joined else min(texts, key=len)[:chars_per_language]
    return Model.train(chosen, change_bits)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


_RUNS = T.ArrayType(T.StructType().add("language", T.StringType()).add("confidence", T.DoubleType()).add("text", T.StringType()))


def language_runs(df: DataFrame, model: Model, text: Column) -> Column:
    """Array of the runs of a text in order: language, confidence, and the run's plain text; empty if it has no words.

    Null and wordless texts have no runs. A text of names only gets the first language at a low confidence. Long texts
    are read whole. Nothing is shuffled; the model is broadcast, its size bounded by the training parameters.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("text", pa.string())]))

    def convert(values: pa.Array) -> pa.Array:
        found = shared.value.runs([plain(v) if v else "" for v in values.to_pylist()])
        flat = [r for runs in found for r in runs]
        languages, confidences, texts = zip(*flat) if flat else ((), (), ())
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        struct = pa.StructArray.from_arrays(
            [pa.array(languages, pa.string()), pa.array(confidences, pa.float64()), pa.array(texts, pa.string())], fields=list(kind.value_type)
        )
        return pa.ListArray.from_arrays(pa.array(offsets), struct)

    # Not to be run again where a filter on the runs is pushed down.
    return F.arrow_udf(convert, _RUNS).asNondeterministic()(text)
