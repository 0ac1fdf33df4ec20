"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts are read as words (runs of letters and digits, A-Z lower-cased) joined by
single spaces, in code points. From a place, the random walk of Chakraborty,
Goldenberg and Koucky puts out a character at each of STEPS steps and then goes
on to the next one or stays, as a coin of step and character says; so few edits
mean few steps that differ, and a walk that an edit throws off can find back.
The coins of PERIOD steps repeat, with as many heads as tails for each
character, so that no character holds a walk forever and the walks from all
places share their steps. A bit sample is the hash of `bits` of the steps.

Walks over a whole item don't reach the target recall where a fifth of it is
edited: they lose their way. So an item's window is sampled from every place in
it, with each of REPEATS samples; a text is sampled at every place too, with the
samples in turn. Where a text's sample equals an item's, it is a collision
with the item-sized window that would begin so many characters before. The
collisions of a window are counted (those within a fifth of the item's length
together), each with the weight one over the root of the sample's uses in the
items. A window whose different collisions have COLLIDE of what the item's weight
would be there is a candidate if, sampled in every way, it has AGREE of all. Samples know no words, so scripts without spaces are
served alike.

How many samples agree was measured on copies of items with a share of the
characters edited, and the repeats, COLLIDE and AGREE follow from it: of copies
that the exact distance accepts, 99 of 100 have 0.06 or more with a fifth of the
characters substituted, inserted or deleted, 95 of 100 have 0.039 with every
sixth character changed, the most regular way; half of the windows of other texts
that reach COLLIDE have 0.027 or less. Tests hold recall to 0.95 by kind of edit,
and to 0.9 for every sixth.

Candidates are verified by the exact edit distance, in code points of the
joined words, of the item to its best place around the window; at most `share`
of the item's may be edited.

Texts are laid in one row of GATHERED code points, apart from each other, and
sampled and counted together; each text has windows of its own, so it gives what
it gives alone.

Items are a stated query set; they are sent to the tasks in blocks of BLOCK
items and BLOCK_CHARS characters at most (a longer item is a block).

Defined results: null and empty texts have no match, nor have items without a
letter or digit; an empty table of either kind gives no rows. Very long texts
are read whole, in stretches that overlap. Items of fewer than EXACT characters
are not sampled; each is searched for as it stands, at the edges of words
(anywhere in scripts without spaces). Of several places with the least edits,
the first that is found counts. Repeated rows of either table give repeated
results; rows with a null item text go. Other columns are not read. Offsets are
code points of the text, the end exclusive; spans are whole words, but for items
of fewer than LEAST words the characters themselves.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, materialize, row_name, table
from tessera.llm.op6_ngram_jaccard import BROADCAST_ROWS, hashed_runs

SHARE, LEAST = 0.2, 4
BLOCK, BLOCK_CHARS = 20_000, 16 << 20
#: Code points of a text whose collisions are counted at a time, so that memory is bounded for texts of any length.
STRETCH = 1 << 15
#: Code points of texts that are sampled and counted together, as a call on a short text alone costs more than what it does, and texts times items of them.
GATHERED, CELLS = 1 << 17, 1 << 20
#: Steps of a walk, after how many its coins repeat, how many of them a sample has, samples, and places of a text from one sample to the next.
STEPS, PERIOD, BITS, REPEATS, STRIDE = 16, 4, 9, 2, 1
#: The shares of an item's weight that make a candidate, in the samples that a text is given and in all samples; the characters from which an item is sampled.
COLLIDE, AGREE, EXACT = 0.028, 0.036, 20
#: Bytes as they are read: A-Z lower-cased, all other ASCII but letters and digits a space. Code points from 128 on are letters.
_READ = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Thai to Lao, Myanmar, Khmer, and from the CJK radicals on: written without spaces.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\uabff\uac00-\ud7ff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


_draw = np.random.Generator(np.random.PCG64(77))
#: For each step of a period and each character (by its low byte) whether the walk goes on.
COINS = np.stack([_draw.permutation(np.arange(PERIOD) % 2) for _ in range(256)], 1).astype(np.intp)
#: The coins of a character as the bits of a byte.
_ON = bytes((COINS << np.arange(PERIOD)[:, None]).sum(0).tolist())


def _samples() -> list[list[np.uint32]]:
    """For each sample and period, the steps that it has, as bytes of a word; the first step is always one."""
    out = []
    for w in range(REPEATS):
        chosen = np.zeros(STEPS, bool)
        chosen[np.random.Generator(np.random.PCG64([5, w])).choice(STEPS, BITS, replace=False)] = True
        chosen[0] = True
        out.append([np.uint32(sum(0xFF << 8 * j for j in range(PERIOD) if chosen[k * PERIOD + j])) for k in range(STEPS // PERIOD)])
    return out


SAMPLES = _samples()
_MULTIPLIERS = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 32, size=STEPS // PERIOD, dtype=np.uint32) | np.uint32(1)


def walked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the walk from every place: what a period's steps put out, as the bytes of a word, and how far they go."""
    n = len(codes)
    c = np.zeros(n + STEPS + 1, np.uint8)
    c[:n] = codes.astype(np.uint8)
    m = n + STEPS - PERIOD
    on = np.frombuffer(c.tobytes().translate(_ON), np.uint8)
    # From the last step back: what the walks put out from this step on, and how far they go; each goes on as its neighbour does, or as it does itself.
    rows = np.empty((PERIOD + 1, len(c)), np.uint8)
    rows[:PERIOD] = c
    rows[PERIOD] = on >> np.uint8(PERIOD - 1)
    for j in range(PERIOD - 2, -1, -1):
        coin = on[:-1] >> np.uint8(j) & np.uint8(1)
        own = rows[j + 1 :, :-1]
        change = own ^ rows[j + 1 :, 1:]
        change &= -coin
        own ^= change
        rows[PERIOD, :-1] += coin
    out = rows[0, :m].astype(np.uint32)
    for j in range(1, PERIOD):
        out |= rows[j, :m].astype(np.uint32) << np.uint32(8 * j)
    return out, rows[PERIOD, :m].astype(np.intp)


def sampled(walks: tuple[np.ndarray, np.ndarray], places: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash, place of the last period) of a sample of the walks from some places."""
    out, far = walks
    at, value = places, np.full(len(places), sample + 1, np.uint32)
    for k, (mask, multiplier) in enumerate(zip(SAMPLES[sample], _MULTIPLIERS, strict=True)):
        if k:
            at = at + far.take(at, mode="clip")  # all are inside; to clip is the fastest way
        own = out.take(at, mode="clip")
        own &= mask
        value ^= own
        value *= multiplier
        value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    return value * np.uint32(0x297A2D39), at


class Words:
    """A text's words: joined by single spaces, as code points, with the place of each in the text."""

    def __init__(self, text: str):
        try:
            wide, low = None, text.encode("latin-1")
        except UnicodeEncodeError:
            wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            low = np.minimum(wide, np.uint32(255)).astype(np.uint8).tobytes()
        c = np.frombuffer(low.translate(_READ), np.uint8)
        self._word = c != 32
        self._codes = c if wide is None else np.where(wide > 255, wide, c)
        keep = self._word.copy()
        keep[1:] |= self._word[:-1]  # the first of what is between two words
        joined = self._codes[keep]
        self._keep, self.joined = keep, joined[:-1] if len(joined) and joined[-1] == 32 else joined

    @cached_property
    def at(self) -> np.ndarray:
        """The place in the text of each of the joined words' code points."""
        return self._keep.nonzero()[0]

    @cached_property
    def ends(self) -> np.ndarray:
        """Of each word, in the joined words."""
        return np.append((self.joined == 32).nonzero()[0], len(self.joined)) if len(self.joined) else np.zeros(0, np.intp)

    @cached_property
    def begins(self) -> np.ndarray:
        return np.append(0, self.ends[:-1] + 1) if len(self.joined) else self.ends

    def __len__(self) -> int:
        return len(self.begins)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        return hashed_runs(self._codes, self._word)[0]

    def word_at(self, place: int) -> int:
        return int(np.searchsorted(self.begins, place, "right")) - 1

    def whole(self, low: int, high: int) -> tuple[int, int]:
        """The part of the text from the word that holds `low` to the one that holds `high` - 1."""
        first, last = self.word_at(low), self.word_at(max(low, high - 1))
        return int(self.at[self.begins[first]]), int(self.at[self.ends[last] - 1]) + 1

    def exact(self, low: int, high: int) -> tuple[int, int]:
        return int(self.at[low]), int(self.at[max(low, high - 1)]) + 1

    def string(self) -> str:
        return as_string(self.joined)


def as_string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def least_edits(item: Sequence[int], region: Sequence[int], most: int | None = None) -> int:
    """The least edit distance of the item to a part of the region, by Myers' bit vectors; where it is `most` or more, any such number."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    up, down, edits, least = full, 0, n, n
    most = n + len(region) if most is None else most
    remaining = len(region)
    for c in region:
        if edits - remaining >= most:  # a step takes one edit at most
            break
        remaining -= 1
        same = masks.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        plus, minus = down | (full & ~(level | up)), up & level
        if plus & top:
            edits += 1
        elif minus & top:
            edits -= 1
            if edits < least:
                least = edits
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(same | down | plus)), plus & (same | down)
    return least


class Benchmark:
    """A block of items, ready to be looked for."""

    def __init__(self, items: Sequence[tuple[int, str]], share: float = SHARE):
        self.share = share
        self.items: list[tuple[int, int, np.ndarray]] = []  # key, how many words, joined words
        self.plain: dict[int, str] = {}  # of items that are searched for as they stand
        self.short: dict[int, list[int]] = defaultdict(list)
        self.loose: list[int] = []
        long = []
        for key, text in items:
            read = Words(text)
            number = len(self.items)
            if not len(read):
                continue
            self.items.append((key, len(read), read.joined))
            if len(read.joined) >= EXACT or len(read) >= LEAST:
                long.append(number)
            if len(read.joined) >= EXACT:
                continue
            plain = self.plain[number] = read.string()
            if _UNSPACED.search(plain):
                self.loose.append(number)
            else:
                self.short[int(read.hashes()[0])].append(number)
        self._index(long)

    def _index(self, long: list[int]) -> None:
        """The samples of all items that have some, in a table by hash, with where each begins and what a collision counts; 1 makes a candidate."""
        values, offsets, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        for i in long:
            joined = self.items[i][2]
            walks, places, own = walked(joined), np.arange(len(joined)), 0
            for w in range(REPEATS):
                value, at = sampled(walks, places, w)
                inside = np.flatnonzero(at + walks[1][at] <= len(joined))  # later ones would see what follows the item
                values.append(value[inside])
                offsets.append(inside)
                own += len(inside)
            size.append(own)
        every, offset = np.concatenate(values), np.concatenate(offsets)
        order = np.argsort(every, kind="stable")
        self.codes, back, uses = np.unique(every, return_inverse=True, return_counts=True)
        self.first, self.uses = np.cumsum(uses) - uses, uses
        owner = np.repeat(np.array(long, np.int64), size)
        weight = (uses**-0.5)[back]
        # Of a window's samples a text has one in STRIDE * REPEATS.
        vote = weight / np.maximum(COLLIDE / (STRIDE * REPEATS) * np.bincount(owner, weight, len(self.items)), 1e-9)[owner]
        self.owner, self.vote, self.offset = owner[order], vote[order], offset[order]
        ends = np.cumsum(np.array(size, np.int64))
        self.own = {i: (back[e - n : e], vote[e - n : e]) for i, e, n in zip(long, ends.tolist(), size, strict=True)}
        self.length = np.array([len(x[2]) for x in self.items], np.int64)
        self.longest = int(self.length.max(initial=0))
        self.span = np.maximum(8, (self.length * self.share).astype(np.int64))
        # Of each collision: what makes a place of the text the end of a window, and the windows' span.
        self.back, self.step = (self.length[self.owner] - self.offset).astype(np.int32), self.span[self.owner].astype(np.int32)
        # The table: samples are in order, so those of one slot follow each other; a slot has the first of them.
        self.shift = np.uint32(32 - min(28, max(16, (16 * len(self.codes)).bit_length())))
        slots = (self.codes >> self.shift).astype(np.int64)
        self.slot = np.full(1 << (32 - int(self.shift)), -1, np.int32)
        self.slot[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.taken = self.slot >= 0  # small enough to stay near the processor

    def _hits(self, walks: tuple[np.ndarray, np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place, sample) in order of places: where a text's walks from the places of each sample have a sample of an item."""
        found, rows = [], []
        for w, start in enumerate(places):
            value, _ = sampled(walks, start, w)
            slot = (value >> self.shift).astype(np.intp)
            at = self.taken.take(slot, mode="clip").nonzero()[0]
            row, value = self.slot.take(slot.take(at)), value.take(at)
            left = (self.codes.take(row) < value).nonzero()[0] if len(at) else at  # codes are in order: a greater one ends the search
            while len(left):
                row[left] = on = np.minimum(row[left] + 1, len(self.codes) - 1)
                left = left[(self.codes.take(on) < value[left]) & (on < len(self.codes) - 1)]
            same = (self.codes.take(row) == value).nonzero()[0] if len(at) else at
            found.append(start.take(at.take(same)))
            rows.append(row.take(same))
        place, row = np.concatenate(found), np.concatenate(rows)
        order = np.argsort(place, kind="stable")
        return place[order], row[order]

    def candidates(self, joined: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low, high): the parts of a text's joined words that collide enough with a window of the item."""
        return self.all_candidates([joined])[0]

    def all_candidates(self, parts: Sequence[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """The candidates of each of some texts, which are laid in one row, far enough apart that no walk from one gets to the next."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
        every = STRIDE * REPEATS
        lengths = np.array([len(x) for x in parts], np.int64)
        taken = -(-(lengths + STEPS + 1) // every) * every  # each begins with the first sample's turn
        first = np.cumsum(taken) - taken
        last = first + lengths
        row_of = np.zeros(int(taken.sum()), np.uint8)
        for low, high, x in zip(first.tolist(), last.tolist(), parts, strict=True):
            row_of[low:high] = x.astype(np.uint8)  # as much as a walk reads
        walks = walked(row_of)
        at, row = self._hits(walks, [np.arange(w * STRIDE, len(row_of), every) for w in range(REPEATS)])
        text = np.searchsorted(first, at, "right") - 1
        inside = (at < last[text]).nonzero()[0]  # not from between the texts
        if not len(inside):
            return out
        at, row, text = at[inside], row[inside], text[inside]
        uses = self.uses[row]
        each = np.repeat(self.first[row] - np.cumsum(uses) + uses, uses) + np.arange(int(uses.sum()))
        bucket = (np.repeat((at - first[text]).astype(np.int32), uses) + self.back[each]) // self.step[each]
        wide = ((lengths[:, None] + self.length) // self.span + 2).ravel()  # windows of a text and an item, and an empty one
        base = np.cumsum(wide) - wide
        keys = base[np.repeat(text * len(self.items), uses) + self.owner[each]] + bucket
        met, back = np.unique(keys, return_inverse=True)
        count = np.bincount(back, self.vote[each])
        # A window counts with the next one; the one before it, which has none itself, counts with it, if it is of the same text and item.
        both = count + np.where(np.append(met[1:] == met[:-1] + 1, False), np.append(count[1:], 0.0), 0.0)
        alone = met[count >= 1]
        alone = alone[alone > base[np.searchsorted(base, alone, "right") - 1]]
        enough = np.unique(np.concatenate([met[both >= 1], alone - 1]))
        if not len(enough):
            return out
        whose = np.searchsorted(base, enough, "right") - 1
        texts, items = whose // len(self.items), whose % len(self.items)
        mark = np.zeros(len(self.codes), bool)
        agree = AGREE / COLLIDE * STRIDE * REPEATS  # votes count parts of COLLIDE in one turn
        span = self.span[items]
        ends = (enough - base[whose] + 3) * span
        begins = np.maximum(0, ends - 4 * span - self.length[items])
        # Where a window is, the samples whose turn it was not are taken as well.
        start, stop = np.minimum(first[texts] + begins, last[texts]), np.minimum(first[texts] + ends, last[texts])
        edges = np.bincount(start, minlength=len(row_of) + 1) - np.bincount(stop, minlength=len(row_of) + 1)
        near = (np.cumsum(edges) > 0).nonzero()[0]
        more, also = self._hits(walks, [near[near % every != w * STRIDE] for w in range(REPEATS)])
        held = [x.tolist() for hits in (at, more) for x in (np.searchsorted(hits, start), np.searchsorted(hits, stop))]
        for k, i, low, high, a, b, c, d in zip(texts.tolist(), items.tolist(), begins.tolist(), ends.tolist(), *held, strict=True):
            w, own = int(self.span[i]), out[k]
            met = np.concatenate([row[a:b], also[c:d]])
            mark[met] = True
            rows, votes = self.own[i]
            once = float(votes[mark[rows]].sum())  # each sample of the item counts once, however often the text repeats it
            mark[met] = False
            if once < agree:
                continue
            if own and own[-1][0] == i and low <= own[-1][1] + 2 * w:  # neighbours of one place
                own[-1] = (i, own[-1][1], high)
            else:
                own.append((i, low, high))
        return out

    def stands(self, item: int, joined: str) -> int:
        """Where a short item stands in a text's joined words, -1 if nowhere."""
        own = self.plain[item]
        at = joined.find(own)
        while at >= 0:
            before, after = joined[max(0, at - 1) : at], joined[at + len(own) : at + len(own) + 1]
            if (before in ("", " ") or _UNSPACED.match(own[0])) and (after in ("", " ") or _UNSPACED.match(own[-1])):
                return at
            at = joined.find(own, at + 1)
        return -1

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item key, edits, start, end) of each item that the text holds, at its best place."""
        return self.all_matches([text])[0]

    def all_matches(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """The matches of each of some texts."""
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        parts: list[tuple[int, Words, int]] = []  # text, its words, a place there
        read_all: list[tuple[int, Words]] = []
        held = 0

        def settle() -> None:
            for (k, read, at), found in zip(parts, self.all_candidates([r.joined[a : a + step + over] for _, r, a in parts]), strict=True):
                for item, low, high in found:
                    self._verify(best[k], read, item, at + low, at + high)
            parts.clear()
            for k, read in read_all:
                self._stand(best[k], read)
            read_all.clear()

        # Stretches overlap by more than any window is long, so each window lies in one of them.
        step, over = max(STRETCH, 4 * self.longest), 2 * self.longest + 64
        for k, text in enumerate(texts if self.items else ()):
            read = Words(text or "")
            for at in range(0, len(read.joined), step):
                size = min(len(read.joined) - at, step + over)
                if parts and (held + size > GATHERED or (len(parts) + 1) * len(self.items) > CELLS):
                    settle()
                    held = 0
                parts.append((k, read, at))
                held += size
            if len(read.joined):
                read_all.append((k, read))
        if parts:
            settle()
        return [[(self.items[i][0], e, s, t) for i, (e, s, t) in sorted(x.items())] for x in best]

    def _verify(self, best: dict[int, tuple[int, int, int]], read: Words, item: int, low: int, high: int) -> None:
        key, own, joined = self.items[item]
        limit = best[item][0] if item in best else int(self.share * len(joined)) + 1
        region = read.joined[max(0, low) : high]
        if not limit or not len(region) or least_edits(joined.tolist(), region.tolist(), limit) >= limit:
            return
        edits, a, b = best_place(joined, region)
        spanned = read.whole if own >= LEAST else read.exact
        best[item] = (edits, *spanned(max(0, low) + a, max(0, low) + b))

    def _stand(self, best: dict[int, tuple[int, int, int]], read: Words) -> None:
        """Items that are searched for as they stand, after all candidates of the text."""
        if not self.plain:
            return
        joined = None
        words = read.hashes().tolist() if self.short else []
        for item in [*self.loose, *(i for w in dict.fromkeys(words) for i in self.short.get(w, ()))]:
            joined = read.string() if joined is None else joined
            at = self.stands(item, joined)
            if at >= 0 and (item not in best or best[item][0]):
                spanned = read.whole if self.items[item][1] >= LEAST else read.exact
                best[item] = (0, *spanned(at, at + len(self.plain[item])))


def best_place(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the exact least edit distance of the item to a part of the region, and that part."""
    at = as_string(region).find(as_string(item))
    if at >= 0:
        return 0, at, at + len(item)
    m = len(region)
    steps = np.arange(m + 1)
    row, origin = np.zeros(m + 1, np.int64), steps.copy()
    for i in range(len(item)):
        # From above and from the diagonal; then along the row by a running minimum.
        new, come = row + 1, origin.copy()
        diagonal = row[:-1] + (region != item[i])
        better = diagonal < new[1:]
        new[1:] = np.where(better, diagonal, new[1:])
        come[1:] = np.where(better, origin[:-1], come[1:])
        level = new - steps
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, steps, 0))
        row, origin = low + steps, come[source]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(key, item key, edits, start, end) for each item that a text holds."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` long, edits long, start long, end long"
    block, held, found = [], 0, None

    def against(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Benchmark(block, share))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                hits = [(k, *hit) for k, found in zip(batch.column(0).to_pylist(), own.all_matches(batch.column(1).to_pylist()), strict=True) for hit in found]
                columns = list(zip(*hits, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, *[pa.int64()] * 4), strict=True)], names=[key, item_key, "edits", "start", "end"])

        return rows.mapInArrow(match, schema)

    for row in items.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long"), item_text).toLocalIterator():
        if block and (len(block) == BLOCK or held + len(row[1]) > BLOCK_CHARS):
            found, block, held = (against(block) if found is None else found.unionByName(against(block))), [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    if block or found is None:
        found = against(block) if found is None else found.unionByName(against(block))
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every item that a document holds."""
    return find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rows that hold an item go, whatever other rows have their id.

    The names of rows are written first and counted, and broadcast if they are
    few, so that the texts need no shuffle.
    """
    named = docs.withColumn("_own", row_name(docs))
    leaks = materialize(find_items(named, table(spark, sf_dir, "benchmark").select("item_id", "text"), "_own").select("_own").distinct(), "leaks")
    leaks = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
    return named.join(leaks, "_own", "left_anti").select(*docs.columns)
