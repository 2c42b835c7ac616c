"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

All segmentations of a text are the paths of a lattice: places between characters, and a piece of the vocabulary, or the
bytes of a character that no piece spells, from one place to another. A unigram model gives every path a probability; sums
from the end make each place's pieces a distribution. Perturbing the log-probability of a path by Gumbel noise and taking the
k largest draws k paths without replacement. The search is A*: the root draws the largest perturbed value of all, one of a
place's pieces inherits its parent's value and the others draw theirs below it, and so a frontier entry's value is exactly the
best that can come of it. Popping the best entry k times, and following its largest child to the end each time, yields the k
samples; the next best entry is the threshold from which the inclusion scores follow.

No piece spans the edge of a word, so a text's lattice is a chain of its words' lattices, and each distinct word of a slice of
texts has one. Along one dive all places share the perturbed value, so the words of all texts of a slice step at once. Noise is
a hash of row key, sample, place and piece length: results depend on the row alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Model file; any file of this format will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Samples per text, seed of the noise, and bytes of text that step at once.
SAMPLES, SEED, STEP_BYTES = 2, 17, 3 << 20
#: How improbable (as a log) a place may be to be looked at first, and a bound of the noise of 32 random bits.
REACH, MOST_NOISE = 5.0, 22.9
#: Units of a log-probability in exact sums, which so don't depend on what else is summed.
FINE = 2.0**32
#: The chunk of a vocabulary whose pieces span words: all of a text.
WHOLE = ".+"
#: How SentencePiece writes a space, and what stands for that mark where a text itself has it (no text holds a lone surrogate).
SPACE, RAW = "▁", "\udfff"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log-probabilities, as a trie in sorted arrays, small and of a fixed size.

    A unigram model's scores are log-probabilities. A BPE model has merge ranks for scores; its pieces get Zipf's law, a
    probability in proportion to one over the rank.
    """

    pieces: list[str]
    logs: np.ndarray  # -inf: not for use
    byte_ids: list[int]  # of the 256 byte pieces, or 256 times the unknown piece

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        plain = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids])
        scores = np.array([model.get_score(i) for i in ids])
        known = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        logs = np.full(len(pieces), -np.inf)
        rank = np.empty(plain.sum())
        rank[np.argsort(-scores[plain], kind="stable")] = np.arange(1, plain.sum() + 1)
        by_rank = np.all(scores[plain] == np.round(scores[plain]))
        logs[plain] = -np.log(rank) - np.log(np.sum(1 / rank)) if by_rank else scores[plain]
        return cls(pieces, logs, [known.get(b, model.unk_id()) for b in range(256)])

    @cached_property
    def chars(self) -> np.ndarray:
        return np.array(sorted({ord(c) for p, w in zip(self.pieces, self.logs, strict=True) if w > -np.inf for c in p}), np.uint32)

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted keys (node times characters plus character), the nodes they lead to, each node's piece or -1, longest piece."""
        number = {int(c): i for i, c in enumerate(self.chars)}
        edges: dict[int, int] = {}
        ends, longest = [-1], 0
        for i in np.flatnonzero(self.logs > -np.inf):
            node = 0
            for c in self.pieces[i]:
                key = node * len(number) + number[ord(c)]
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = int(i)
            longest = max(longest, len(self.pieces[i]))
        keys = np.array(sorted(edges), np.int64)
        kind = np.int32 if len(ends) * len(number) < 1 << 31 else np.int64
        return keys.astype(kind), np.array([edges[k] for k in keys.tolist()], np.int32), np.array(ends, np.int32), longest

    @cached_property
    def roots(self) -> np.ndarray:
        """The node of every first character, by its number, and last a 0 for none."""
        keys, nodes, _, _ = self.trie
        out = np.zeros(len(self.chars) + 1, nodes.dtype)
        upto = np.searchsorted(keys, len(self.chars))
        out[keys[:upto]] = nodes[:upto]
        return out

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The trie's keys and nodes by hash, each in the first free slot from its hash on; -1 is free."""
        keys, nodes, _, _ = self.trie
        size = 1 << max(4, (4 * len(keys)).bit_length())
        slots, held = np.full(size, -1, keys.dtype), np.zeros(size, nodes.dtype)
        left, at = np.arange(len(keys)), _slots(keys, size)
        while len(left):
            _, won = np.unique(at, return_index=True)
            won = won[slots[at[won]] < 0]
            slots[at[won]], held[at[won]] = keys[left[won]], nodes[left[won]]
            left, at = np.delete(left, won), (np.delete(at, won) + 1) & (size - 1)
        return slots, held

    def nodes_at(self, keys: np.ndarray) -> np.ndarray:
        """The nodes that some keys lead to, 0 for none."""
        slots, held = self.table
        at = _slots(keys, len(slots))
        there = slots[at]
        out = np.where(there == keys, held[at], held.dtype.type(0))
        on = np.flatnonzero((there != keys) & (there >= 0))
        at = at[on]
        while len(on):
            at = (at + 1) & (len(slots) - 1)
            there = slots[at]
            same = there == keys[on]
            out[on[same]] = held[at[same]]
            more = ~same & (there >= 0)
            on, at = on[more], at[more]
        return out

    @cached_property
    def number_of(self) -> np.ndarray:
        """The number of every code point among the vocabulary's characters, or -1."""
        out = np.full(0x110000, -1, np.int32)
        out[self.chars] = np.arange(len(self.chars))
        return out

    @cached_property
    def byte_log(self) -> float:
        """Log-probability of a byte: that of the rarest piece."""
        return float(self.logs[self.logs > -np.inf].min(initial=-10.0))

    @cached_property
    def words(self) -> re.Pattern:
        """Where a text can be cut without cutting a piece: before a space after other marks, and around line ends."""
        used = [p for p, w in zip(self.pieces, self.logs, strict=True) if w > -np.inf]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in used):
            return re.compile(WHOLE, re.S)
        return re.compile(rf"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    @cached_property
    def spelled(self) -> list[bytes]:
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            if self.pieces[i].startswith("<0x"):
                out[i] = bytes([b])
        return out

    def __getstate__(self):
        # computed once, sent with the broadcast
        self.chars, self.trie, self.byte_log, self.words, self.spelled  # noqa: B018
        return {k: v for k, v in self.__dict__.items() if k not in ("number_of", "roots", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def chunks(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(SPACE, RAW).replace(" ", SPACE)) if text else []

    def keys(self, text: str) -> list[str]:
        """The chunks in short: one that is a space and a word as the word alone, any other after a line end."""
        if not text:
            return []
        if self.words.pattern == WHOLE or "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text:
            return [c[1:] if c[0] == SPACE and c[1:2] not in ("", SPACE) else "\n" + c for c in self.chunks(text)]
        out: list[str] = []
        for n, line in enumerate((text.replace(SPACE, RAW) if SPACE in text else text).split("\n")):
            words = line.split(" ") if line else []
            if n:
                out.append("\n\n")
                if words:
                    words[0] = "\n" + words[0]
            elif not words:
                words = ["\n" + SPACE]
            out += words
        return out

    def same(self, texts: list[str], values: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether decoding the ids between two offsets gives the text again, for many texts at once."""
        spelled = pa.array(self.spelled, pa.large_binary()).take(pa.array(values))
        ends, held = np.frombuffer(spelled.buffers()[1], np.int64, len(values) + 1)[offsets].tolist(), spelled.buffers()[2]
        joined, out = held.to_pybytes() if held else b"", []
        for i, text in enumerate(texts):
            start, end = ends[i], ends[i + 1]
            # the space in front, which encoding puts there, and then the text to the byte; else what characters come of it
            plain = joined[start:end] == b" " + text.encode("utf-8", "surrogatepass")
            out.append(plain or self.decode(values[offsets[i] : offsets[i + 1]].tolist()) == text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; the space that encoding puts in front is taken off again."""
        spelled = self.spelled
        return b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Lattice:
    """The lattices of some words, end to end in one row of characters.

    Arcs are sorted by place, a place's from ``first`` on; ``piece`` is -1 for the bytes of a character of several.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)[:-1]))
        self.stop = np.repeat(self.start + sizes, sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        self.first, self.place, self.size, self.piece = self._arcs(vocabulary)
        log = vocabulary.logs[self.piece]
        spelled = np.flatnonzero(self.piece < 0)
        if len(spelled):
            c = self.codes[self.place[spelled]]
            log[spelled] = vocabulary.byte_log * (1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
            one = c < 0x80
            self.piece[spelled[one]] = np.array(vocabulary.byte_ids, np.int32)[c[one]]
        # a word has one place more than characters, its end, from where nothing is ahead
        here, there = self.place + word[self.place], self.place + self.size + word[self.place]
        ahead = np.zeros(len(self.codes) + len(words))
        self._sum_ahead(ahead, log, here, there)
        self.log = log + ahead[there] - ahead[here]
        self.share = np.exp(self.log)
        self.fine = np.round(self.log * FINE).astype(np.int64)

    def _arcs(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First arc of each place; place, length and piece (-1: bytes) of each arc. All places walk the trie together."""
        keys, _, ends, longest = vocabulary.trie
        width = keys.dtype.type(len(vocabulary.chars))
        number = vocabulary.number_of[self.codes]
        alive, node = np.arange(len(self.codes), dtype=np.int32), keys[:0]
        left = (self.stop - np.arange(len(self.codes))).astype(np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(self.codes), np.int32)
        roots = vocabulary.roots
        for length in range(1, longest + 1):
            if length == 1:
                node = roots[number]  # of an unknown character the last, which is no node
                hit = np.flatnonzero(node > 0)
                alive, node = alive[hit], node[hit]
            else:
                inside = np.flatnonzero(left[alive] >= length)
                alive, node = alive[inside], node[inside]
                char = number[alive + (length - 1)]
                known = np.flatnonzero(char >= 0)
                alive, node = alive[known], vocabulary.nodes_at(node[known] * width + char[known])
                hit = np.flatnonzero(node)
                alive, node = alive[hit], node[hit]
            piece = ends[node]
            ended = piece >= 0
            found.append((alive[ended], piece[ended]))
            if length == 1:
                bytes_only = np.ones(len(self.codes), bool)
                bytes_only[found[0][0]] = False
            count[found[-1][0]] += 1
            if not len(alive):
                break
        count += bytes_only
        edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)))
        first = edges[:-1].copy()
        place = np.repeat(np.arange(len(self.codes)), count)
        size, pieces = np.ones(len(place), np.int32), np.full(len(place), -1, np.int32)
        first += bytes_only  # a place's bytes come before its pieces
        for length, (at, piece) in enumerate(found, 1):
            to = first[at]
            size[to], pieces[to] = length, piece
            first[at] += 1
        return edges, place, size, pieces

    def _sum_ahead(self, ahead: np.ndarray, log: np.ndarray, here: np.ndarray, there: np.ndarray) -> None:
        """Log of the summed probabilities of all ways to a word's end; places as far from their end go together."""
        away = self.stop[self.place] - self.place
        if away.max(initial=0) < 1 << 16:
            away = away.astype(np.uint16)  # sorts by counting
        order = np.argsort(away, kind="stable")
        turns = np.flatnonzero(np.diff(away[order])) + 1
        for arcs in np.split(order, turns):
            value, at = log[arcs] + ahead[there[arcs]], here[arcs]
            cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            top = np.maximum.reduceat(value, cut)
            share = np.exp(value - np.repeat(top, np.diff(np.append(cut, len(arcs)))))
            ahead[at[cut]] = top + np.log(np.add.reduceat(share, cut))


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """A slot of a table of a power of two slots for each key."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Path:
    """One sampled segmentation: the word and arc of each piece, in order, its perturbed value and log-probability."""

    word: np.ndarray
    arc: np.ndarray
    value: float
    log: float = 0.0


class Sampler:
    """Searches the lattices of a slice of texts."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str | None], seeds: list[int], samples: int):
        keys = [vocabulary.keys(t or "") for t in texts]
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        flat = list(chain.from_iterable(keys))
        known: dict[str, int] = defaultdict(count().__next__)
        self.of = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        words = [k[1:] if k[0] == "\n" else SPACE + k for k in known]
        self.samples, self.seeds = samples, np.array(seeds, np.uint64)
        self.begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
        self.text = np.repeat(np.arange(len(texts)), counts)
        if not len(self.of):
            return
        self.lattice = Lattice(vocabulary, words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))[self.of]
        ends = np.cumsum(sizes)
        # characters of the text before each word, and so the place in the text of each place of its lattice
        before = ends - sizes
        self.shift = before - before[self.begin[:-1].clip(max=len(before) - 1)][self.text] - self.lattice.start[self.of]

    def _hashes(self, word: np.ndarray, place: np.ndarray, sample: int) -> np.ndarray:
        """A hash per text, sample and place in the text."""
        salt = _mixed(self.seeds + np.uint64(sample * 0x9E3779B97F4A7C15 % (1 << 64)))
        spot = (place + self.shift[word]).astype(np.uint64)
        return _mixed(salt[self.text[word]] ^ (spot * np.uint64(0xD6E8FEB86659FD93)))

    def dive(self, word: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Follow the largest child from the given places to their words' ends: word and arc of every piece, in order.

        Which child is the largest doesn't depend on its value: it is drawn by the children's probabilities. All of a path's
        places have the same perturbed value, so that words need not wait for the one before.
        """
        lat = self.lattice
        words, arcs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(word):
            arc, last = lat.first[place], lat.first[place + 1] - 1
            forks = np.flatnonzero(arc < last)
            draw = _uniform(self._hashes(word[forks], place[forks], sample))
            at, end = arc[forks], last[forks]
            while len(forks):
                draw = draw - lat.share[at]
                on = np.flatnonzero((draw >= 0) & (at < end))
                arc[forks] = at
                forks, at, end, draw = forks[on], at[on] + 1, end[on], draw[on]
            words.append(word)
            arcs.append(arc)
            place = place + lat.size[arc]
            goes = np.flatnonzero(place < lat.stop[lat.place[arc]])
            word, place = word[goes], place[goes]
        words, arcs = np.concatenate(words), np.concatenate(arcs)
        order = np.argsort(words, kind="stable")
        return words[order], arcs[order]

    def _children(self, words, arcs, at, before, value, sample, least):
        """The left-out children of some places of a dive that may beat a value per text: (text, value, word, arc) arrays.

        ``before`` holds the places' log-probabilities. A child's value is below its place's log-probability less the log of
        one minus its uniform draw, so only few need working out.
        """
        lat = self.lattice
        place = lat.place[arcs[at]]
        first, many = lat.first[place], lat.first[place + 1] - lat.first[place]
        arc = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        owner = np.repeat(np.arange(len(at)), many)
        bits = _mixed(np.repeat(self._hashes(words[at], place, sample), many) + lat.size[arc].astype(np.uint64)) >> np.uint64(32)
        chance = (bits.astype(np.float64) + 0.5) * 2.0**-32
        may = np.exp(np.minimum(before - least[self.text[words[at]]], 700.0))
        rest = np.flatnonzero((arc != arcs[at][owner]) & (1 - chance < may[owner]))
        owner, arc, word = owner[rest], arc[rest], words[at][owner[rest]]
        text = self.text[word]
        log = before[owner] + lat.log[arc]
        child = log - np.log(np.exp(np.minimum(log - value[text], 700.0)) - np.log(chance[rest]))
        return text, child, word, arc

    def left_out(self, words, arcs, value, given, sample, wanted) -> list[list[tuple[float, int, int]]]:
        """Each text's best children that a dive left out, as (perturbed value, word, arc), ``wanted`` at most.

        A child other than the largest has a Gumbel value cut off at its parent's. ``value`` and ``given`` hold each text's
        perturbed value and the log-probability (in FINE units, so that sums are exact) of what came before the dive. The
        more probable places give a value to beat; of the others those are looked at that can beat it, as noise is at most
        MOST_NOISE.
        """
        n, text = len(self.seeds), self.text[words]
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.lattice.fine[arcs])))
        begin = np.searchsorted(words, self.begin)
        before = (sums[:-1] + (given - sums[begin[:-1]])[text]) / FINE
        best: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
        above, beat, floor = np.full(n, np.inf), np.full(n, -np.inf), -REACH
        bottom = np.full(n, np.inf)
        np.minimum.at(bottom, text, before)
        left = np.isfinite(bottom)
        while left.any():
            # down to the floor where nothing is known yet, down to what can still beat the value that is known
            low = np.where(np.isfinite(beat), beat - MOST_NOISE, floor)
            at = np.flatnonzero(left[text] & (before <= above[text]) & (before > low[text]))
            own, child, word, arc = self._children(words, arcs, at, before[at], value, sample, beat)
            order = np.lexsort((-child, own))
            sorted_own = own[order]
            for i in order[np.arange(len(own)) - np.searchsorted(sorted_own, sorted_own) < wanted].tolist():
                best[own[i]].append((float(child[i]), int(word[i]), int(arc[i])))
            done = left & (np.isfinite(beat) | (bottom > low))
            for i in np.flatnonzero(left).tolist():
                best[i] = sorted(best[i], reverse=True)[:wanted]
                if len(best[i]) == wanted:
                    beat[i] = best[i][-1][0]
            above, left = low, left & ~done
            floor *= 4
        return best

    def run(self) -> list[tuple[list[Path], float]]:
        """Each text's samples, best first, and the value of the next one (-inf if there is none)."""
        n, none = len(self.seeds), np.zeros(0, np.int64)
        value = -np.log(-np.log(_uniform(_mixed(self.seeds ^ np.uint64(0xA0761D6478BD642F)))))
        found: list[list[Path]] = [[Path(none, none, float(v))] for v in value]
        if not len(self.of):
            return [(paths, -np.inf) for paths in found]
        lat, frontier = self.lattice, [[] for _ in range(n)]
        heads = {i: (none, none) for i in range(n)}
        at, places, given = np.arange(len(self.of)), lat.start[self.of], np.zeros(n, np.int64)
        for sample in range(self.samples):
            words, arcs = self.dive(at, places, sample)
            cut = np.searchsorted(words, self.begin)
            for i, (w, a) in heads.items():
                path = Path(np.concatenate((w, words[cut[i] : cut[i + 1]])), np.concatenate((a, arcs[cut[i] : cut[i + 1]])), float(value[i]))
                path.log = float(lat.log[path.arc].sum())
                found[i] = [path] if sample == 0 else [*found[i], path]
            for i, mine in enumerate(self.left_out(words, arcs, value, given, sample, self.samples - sample)):
                frontier[i] += [(v, sample, w, a) for v, w, a in mine]
            if sample + 1 == self.samples:
                break
            heads, at, places, value, given = {}, [none], [none], np.zeros(n), np.zeros(n, np.int64)
            for i in range(n):
                if not frontier[i]:
                    continue
                best = max(frontier[i])
                frontier[i].remove(best)
                value[i], parent, w, a = best
                path = found[i][parent]
                lo, hi = np.searchsorted(path.word, (w, w + 1))
                cut = lo + np.searchsorted(lat.place[path.arc[lo:hi]], lat.place[a])
                heads[i] = (np.append(path.word[:cut], w), np.append(path.arc[:cut], a))
                given[i] = lat.fine[heads[i][1]].sum()
                end = lat.place[a] + lat.size[a]
                if end < lat.stop[lat.place[a]]:
                    at.append(np.array([w]))
                    places.append(np.array([end]))
                later = np.arange(w + 1, self.begin[i + 1])
                at.append(later)
                places.append(lat.start[self.of[later]])
            at, places = np.concatenate(at), np.concatenate(places)
        return [(found[i], max(frontier[i])[0] if frontier[i] else -np.inf) for i in range(n)]

    def ids(self, path: Path, vocabulary: Vocabulary) -> np.ndarray:
        """The piece ids of a path, a character that no piece spells as its bytes."""
        if not len(path.arc):
            return path.arc
        out = self.lattice.piece[path.arc]
        spelled = np.flatnonzero(out < 0)
        if not len(spelled):
            return out
        parts, done = [], 0
        for at in spelled.tolist():
            char = chr(self.lattice.codes[self.lattice.place[path.arc[at]]])
            meant = {RAW: SPACE, SPACE: " "}.get(char, char)
            parts += [out[done:at], [vocabulary.byte_ids[b] for b in meant.encode()]]
            done = at + 1
        return np.concatenate([*parts, out[done:]]).astype(np.int64)


def sample(vocabulary: Vocabulary, texts: list[str | None], keys: list[str], samples: int = SAMPLES, seed: int = SEED) -> list[list[dict]]:
    """Up to ``samples`` different segmentations of each text, best perturbed value first, with inclusion scores.

    ``log_prob`` is the segmentation's log-probability, ``perturbed`` its perturbed value, and ``inclusion`` the probability
    that a perturbed value of it passes the threshold, the value of the best segmentation left out (1 if none is).
    """
    search = Sampler(vocabulary, texts, [xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), seed) for k in keys], samples)
    out = []
    for paths, threshold in search.run():
        out.append([
            {
                "ids": search.ids(p, vocabulary), "log_prob": p.log, "perturbed": p.value,
                "inclusion": float(-np.expm1(-np.exp(min(700.0, p.log - threshold)))) if threshold > -np.inf else 1.0,
            }
            for p in paths
        ])
    return out


def segmentations(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sampled segmentations of every whole text.

    A row per document and sample: ``doc_id``, ``sample`` (1 is the largest perturbed value), ``n_pieces``, ``ids``,
    ``log_prob``, ``perturbed``, ``inclusion`` and ``round_trip`` (whether decoding the ids gives the text again). A text with
    fewer segmentations has fewer rows. Null and empty texts have one segmentation, without pieces. The noise is seeded by the
    id (a null one too), so equal rows have equal samples. The model file is read on the driver and its pieces, of a fixed
    number, are broadcast.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def work(part: pa.RecordBatch) -> dict:
        v = vocabulary.value
        keys, texts = part.column("key").to_pylist(), part.column("text").to_pylist()
        found = sample(v, texts, keys, samples)
        rows = [(i, k, s) for i, every in enumerate(found) for k, s in enumerate(every, 1)]
        ids = [s["ids"] for _, _, s in rows]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        values = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
        return {
            "doc_id": part.column("doc_id").take(pa.array([i for i, _, _ in rows], pa.int64())), "sample": [k for _, k, _ in rows],
            "n_pieces": [len(x) for x in ids], "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(LIST),
            "round_trip": v.same([texts[i] or "" for i, _, _ in rows], values, offsets),
        } | {name: [s[name] for _, _, s in rows] for name in ("log_prob", "perturbed", "inclusion")}

    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, sample int, n_pieces long, ids array<int>, log_prob double, perturbed double, inclusion double, "
        "round_trip boolean"
    )
    return map_slices(rows, "text", work, schema, size=STEP_BYTES)


#: Arrow's type of an array of ids.
LIST = pa.list_(pa.field("element", pa.int32()))


def encoded(docs: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of SentencePiece's own encoding of each text; null for a null text."""
    import sentencepiece

    with open(model, "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())
    names = docs.columns

    def work(part: pa.RecordBatch) -> dict:
        processor = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        texts = part.column(text).to_pylist()
        ids = processor.encode([t or "" for t in texts], num_threads=1)
        return {n: part.column(n) for n in names} | {out: [None if t is None else i for t, i in zip(texts, ids, strict=True)]}

    return map_slices(docs, text, work, docs.select("*", F.lit(None).cast("array<int>").alias(out)).schema)


def decoded(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of each row's ids in ``out``; null for null ids."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = [c for c in rows.columns if c != out]

    def work(part: pa.RecordBatch) -> dict:
        texts = [None if i is None else vocabulary.value.decode(i) for i in part.column(ids).to_pylist()]
        return {n: part.column(n) for n in names} | {out: texts}

    return map_slices(rows.select(*names), ids, work, rows.select(*names, F.lit(None).cast("string").alias(out)).schema)
