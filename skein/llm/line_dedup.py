"""Line dedup by pairwise alignment of overlapping documents.

Overlapping documents are found through shared hashes of lines or, where lines are short, of runs of lines: from every
line on, the fewest lines that hold ``min_words`` words. Each such run that at least two documents hold makes each
later document a partner of its first holder -- one pair per document and holder, however many documents share it, so
nothing grows with the square of a group. A holder's lines are sent once per *cell* of asking blocks, so a holder that
a third of all documents meet is spread over many tasks. Each pair is aligned with patience diff over the hashes of all
lines, then what is left of the later document with any place of the holder; aligned common blocks of ``min_words``
words are deleted from the later document. Of scripts written without spaces every two characters count as one more
word of their line.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Packer, counts, deal, expand, in_order, rounds, rows
from .textnum import U, mix, powers, span_hashes, utf8, word_spans


def unspaced(buf: np.ndarray) -> np.ndarray:
    """Whether a character of a script without spaces begins at each byte: Thai, Lao, Burmese, Khmer, kana, Han."""
    out = np.zeros(len(buf), bool)
    lead = np.flatnonzero((buf[:-1] >= 0xE0) & (buf[:-1] <= 0xF0))
    a, b = buf[lead], buf[lead + 1]
    out[lead] = ((a >= 0xE4) & (a <= 0xE9) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
                 | (a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F))
                 | (a == 0xE3) & ((b >= 0x81) & (b <= 0x83) | (b >= 0x90)) | (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3))
    return out


class Lines:
    """The lines of a block's documents: place in the bytes, words, hash of the trimmed line (0 if blank); hash of the
    fewest lines from each on that hold ``min_words`` words (0 if the line is blank or the document has fewer)."""

    def __init__(self, texts, min_words: int):
        self.buf, offs = utf8(texts)
        starts, ends, _ = word_spans(self.buf, offs)
        breaks = np.flatnonzero(self.buf == 10)
        n_docs = len(offs) - 1
        of_break = np.searchsorted(offs, breaks, "right") - 1
        filled = np.flatnonzero(np.diff(offs) > 0)  # an empty text has no lines
        doc = np.r_[filled, of_break]
        begin, stop_doc = np.r_[offs[filled], breaks + 1], doc
        order = np.lexsort((begin, stop_doc))
        self.doc, self.begin = doc[order], begin[order]
        self.first = np.searchsorted(self.doc, np.arange(n_docs + 1))
        last = np.r_[self.doc[1:] != self.doc[:-1], True] if len(self.doc) else np.zeros(0, bool)
        self.end = np.where(last, offs[self.doc + 1], np.r_[self.begin[1:], 0] - 1) if len(self.doc) else self.begin
        a, b = np.searchsorted(starts, self.begin), np.searchsorted(starts, self.end)
        self.words = b - a
        self.hash = np.zeros(len(self.doc), np.uint64)
        some = self.words > 0
        self.hash[some] = span_hashes(self.buf, starts[a[some]], ends[b[some] - 1]) | U(1)
        chars = np.flatnonzero(unspaced(self.buf))
        if len(chars):
            self.words += (np.searchsorted(chars, self.end) - np.searchsorted(chars, self.begin)) // 2
        total = np.r_[0, np.cumsum(self.words)]
        stop = np.searchsorted(total, total[:-1] + max(1, min_words))  # the line after the run
        self.runs = np.flatnonzero(some & (stop <= self.first[self.doc + 1]))
        self.run = np.where(some, self.hash, U(0))
        pw, inv = powers(len(self.doc) + 1)
        sums = np.r_[U(0), np.cumsum(mix(self.hash + U(1)) * pw[:-1])]
        long = self.runs[stop[self.runs] > self.runs + 1]
        self.run[long] = mix((sums[stop[long]] - sums[long]) * inv[long]) | U(1)

    def of(self, doc: int) -> slice:
        return slice(int(self.first[doc]), int(self.first[doc + 1]))


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two sequences: common ends, then lines unique on both sides in a longest rising run, and so
    on between them."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, j, k, n = work.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append((j, n))
        if i >= j or k >= n:
            continue
        once_a, once_b = {}, {}
        for x in range(i, j):
            once_a[a[x]] = None if a[x] in once_a else x
        for y in range(k, n):
            once_b[b[y]] = None if b[y] in once_b else y
        pairs = [(x, once_b[v]) for v, x in once_a.items() if x is not None and once_b.get(v) is not None]
        if not pairs:
            continue
        tails, top, back = [], [], []
        for p, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            tails[at:at + 1], top[at:at + 1] = [y], [p]
            back.append(top[at - 1] if at else -1)
        chain, p = [], top[-1]
        while p >= 0:
            chain.append(pairs[p])
            p = back[p]
        chain.reverse()
        for (x, y), (x2, y2) in zip([(i, k), *[(x + 1, y + 1) for x, y in chain]], [*chain, (j, n)]):
            work.append((x, x2, y, y2))
        out += chain
    return sorted(out)


def runs_in(a: list, b: list) -> list[int]:
    """For each place of ``b``: of how many lines the longest run is that ends there and stands somewhere in ``a``."""
    step, link, size, last = [{}], [-1], [0], 0  # suffix automaton of a: linear in its lines
    for v in a:
        new, p = len(step), last
        step.append({}), link.append(0), size.append(size[last] + 1)
        while p >= 0 and v not in step[p]:
            step[p][v] = new
            p = link[p]
        if p >= 0:
            q = step[p][v]
            if size[q] != size[p] + 1:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1)
                while p >= 0 and step[p].get(v) == q:
                    step[p][v] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    out, at, n = [], 0, 0
    for v in b:
        while at and v not in step[at]:
            at = link[at]
            n = size[at]
        if v in step[at]:
            at, n = step[at][v], n + 1
        out.append(n)
    return out


def aligned(a: list, b: list, words: list, least: int = 1) -> list[int]:
    """Places of ``b`` in common blocks (runs matched side by side) whose ``words`` add up to ``least`` or more.

    The patience alignment comes first. Common lines it leaves -- passages that stand several times in a text, or in
    another order -- are aligned again, each run with any place of ``a`` where it stands; so in the end a line goes if
    and only if it is in a run of so many words that stands side by side in ``a`` too.
    """
    gone, run, held = [False] * len(b), [], 0
    before = None
    for x, y in [*patience(a, b), (None, None)]:
        if before is not None and x is not None and (x, y) == (before[0] + 1, before[1] + 1):
            run.append(y)
        else:
            if held >= least:
                for z in run:
                    gone[z] = True
            run, held = [y], 0
        held += words[y] if y is not None else 0
        before = (x, y)
    known, left, y = set(a), [], 0
    while y < len(b):  # stretches of common lines of so many words that are not gone as a whole
        z = y
        while z < len(b) and b[z] in known:
            z += 1
        if not all(gone[y:z]) and sum(words[y:z]) >= least:
            left.append((y, z))
        y = z + 1
    if left:
        longest = runs_in(a, [v for y, z in left for v in [*b[y:z], None]])
        at = 0
        for y, z in left:
            low = z  # first place that a run of so many words covers, from the end of the stretch on
            total = [0, *accumulate(words[y:z])]
            for i in range(z - y - 1, -1, -1):
                begin = i - longest[at + i] + 1
                if total[i + 1] - total[begin] >= least:
                    low = min(low, y + begin)
                if y + i >= low:
                    gone[y + i] = True
            at += z - y + 1
    return [y for y, x in enumerate(gone) if x]


def line_dedup(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text",
               keep: tuple[str, ...] = (), n_blocks: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, n_lines, n_removed, text) and the columns named in ``keep``.

    Lines end at ``\\n`` and are compared without the white space around them; the kept ones are joined by ``\\n`` as they
    were. Documents are in the order of their ids. ``min_words`` is what a common block holds at least. Defined cases: null and empty texts have no lines and become empty;
    null ids come first; rows that share an id are separate documents in the order of their texts, so of repeated rows
    the first stays whole; blank lines go only inside an aligned block; an empty table gives an empty result; other
    columns are not read, whatever their names.
    """
    n_blocks, n_buckets = n_blocks or counts(docs), n_buckets or counts(docs)
    cells = 1 << max(0, (n_blocks.bit_length() + 1) // 2)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    extra = [f"_keep{i}" for i in range(len(keep))]
    dealt = deal(docs, n_blocks, id_col, text_col, {e: F.col(c) for e, c in zip(extra, keep)})

    def distinct(lines: Lines):
        """(hash, first document, several documents) of each distinct run that can make partners, by bucket."""
        at = lines.runs
        order = at[np.lexsort((lines.doc[at], lines.run[at]))]
        h, doc = lines.run[order], lines.doc[order]
        new = np.r_[True, h[1:] != h[:-1]][:len(h)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(h)] - 1
        value, holder, several = h[first], doc[first], doc[last] != doc[first]
        bucket = ((value >> U(1)) % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return value[order], holder[order], several[order], bucket[order]

    def find(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table, ids = in_order(table)
        value, holder, several, bucket = distinct(Lines(table["text"], min_words))
        buckets, first = np.unique(bucket, return_index=True)
        cuts = [*first.tolist(), len(value)]
        return rows(block, buckets, [Packer().put(value[a:b]).put(ids[holder[a:b]]).put(holder[a:b]).put(several[a:b])
                                     .squeezed() for a, b in zip(cuts, cuts[1:])])

    def resolve(table: pa.Table) -> pa.Table:
        """To each block: for its runs that several documents hold, the first holder; to holders: the cells to serve."""
        value, ids, holder, several, n = [], [], [], [], []
        for data in table["data"].to_pylist():
            p = Packer.of_squeezed(data)
            value.append(p.get(np.uint64)), ids.append(p.get(np.int64))
            holder.append(p.get(np.int64)), several.append(p.get(bool))
            n.append(len(value[-1]))
        value, ids, holder, several = map(np.concatenate, (value, ids, holder, several))
        blocks = table["block"].to_numpy().astype(np.int64)
        block = np.repeat(blocks, n)
        order = np.lexsort((holder, block, ids, value))
        new = np.r_[True, value[order][1:] != value[order][:-1]]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        lead = order[new]  # the entry of each run's first holder
        shared = (np.bincount(group) > 1) | (np.bincount(group, weights=several) > 0)
        tell = shared[group]
        asks = tell & (several | (lead[group] != np.arange(len(group))))  # its block has a document after the holder
        out = []
        nth = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
        source = np.unique(np.stack([block[lead[group]], holder[lead[group]], block % cells], 1)[asks], axis=0)
        for b, a, z in zip(blocks, np.cumsum(n) - n, np.cumsum(n)):
            mine = np.arange(a, z)[asks[a:z]]
            serve = source[source[:, 0] == b][:, 1:]
            out.append(Packer().put(nth[mine]).put(block[lead[group[mine]]]).put(holder[lead[group[mine]]])
                       .put(serve).squeezed() if len(mine) or len(serve) else None)
        told = [i for i, x in enumerate(out) if x is not None]
        return rows(blocks[told], table["bucket"][0].as_py(), [out[i] for i in told])

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return rows(0, 0, [])
        block = table["block"][0].as_py()
        table, _ = in_order(table)
        lines = Lines(table["text"], min_words)
        value, _, _, bucket = distinct(lines)
        begin = np.searchsorted(bucket, np.arange(n_buckets))
        pairs, serve, line, from_block, from_doc = [], [], [], [], []
        for b, data in zip(replies["bucket"].to_pylist(), replies["data"].to_pylist()):
            p = Packer.of_squeezed(data)
            line.append(p.get(np.int64) + begin[b]), from_block.append(p.get(np.int64)), from_doc.append(p.get(np.int64))
            serve.append(p.get(np.int64).reshape(-1, 2))
        line, from_block, from_doc = map(np.concatenate, (line, from_block, from_doc))
        # the block's documents that hold those runs, each with the run's first holder
        order = np.argsort(value[line])
        known = value[line][order]
        at = lines.runs
        if len(known):
            place = np.minimum(np.searchsorted(known, lines.run[at]), len(known) - 1)
            hit = known[place] == lines.run[at]
            who, src = lines.doc[at][hit], order[place[hit]]
            pairs = np.unique(np.stack([who, from_block[src], from_doc[src]], 1), axis=0)
            pairs = pairs[(pairs[:, 1] != block) | (pairs[:, 2] != pairs[:, 0])]
        else:
            pairs = np.zeros((0, 3), np.int64)
        serve = np.unique(np.concatenate(serve), axis=0)
        serve = np.stack([np.full(len(serve), block), serve[:, 0], serve[:, 1]], 1)
        # rows: side, holder's block and document, cell, own document
        out = np.concatenate([
            np.stack([np.zeros(len(serve), np.int64), serve[:, 0], serve[:, 1], serve[:, 2], serve[:, 1]], 1),
            np.stack([np.ones(len(pairs), np.int64), pairs[:, 1], pairs[:, 2],
                      np.full(len(pairs), block % cells), pairs[:, 0]], 1)])
        key = mix(mix((out[:, 1] << 32).astype(np.uint64) + out[:, 2].astype(np.uint64)) + out[:, 3].astype(np.uint64))
        home = (key % U(n_buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        out, home = out[order], home[order]
        buckets, first = np.unique(home, return_index=True)
        cuts, data = [*first.tolist(), len(out)], []
        for a, b in zip(cuts, cuts[1:]):
            o = out[a:b]
            used, nth = np.unique(o[:, 4], return_inverse=True)
            n = lines.first[used + 1] - lines.first[used]
            where = expand(lines.first[used], n)
            data.append(Packer().put(np.c_[o, nth]).put(n).put(lines.hash[where])
                        .put(np.minimum(lines.words[where], max(1, min_words)).astype(np.int32)).squeezed())
        return rows(block, buckets, data)

    def decide(table: pa.Table) -> pa.Table:
        blocks = table["block"].to_numpy()
        holders, later = {}, []
        for i, data in enumerate(table["data"].to_pylist()):
            p = Packer.of_squeezed(data)
            o, n = p.get(np.int64).reshape(-1, 6).tolist(), p.get(np.int64)
            ends = np.cumsum(n).tolist()
            hashes, words = p.get(np.uint64).tolist(), p.get(np.int32).tolist()
            for side, b, d, cell, own, nth in o:
                s = slice(ends[nth] - int(n[nth]), ends[nth])
                if side:
                    later.append((i, (b, d, cell), own, hashes[s], words[s]))
                else:
                    holders[b, d, cell] = hashes[s]
        found: dict[int, list] = {}
        for i, key, own, hashes, words in later:
            gone = aligned(holders[key], hashes, words, max(1, min_words))
            if gone:
                found.setdefault(i, []).append(np.stack([np.full(len(gone), own), np.array(gone)], 1))
        return rows(blocks[list(found)], table["bucket"][0].as_py(),
                    [Packer().put(np.concatenate(x).astype(np.int64)).squeezed() for x in found.values()])

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        table, _ = in_order(table, extra)
        lines = Lines(table["text"], min_words)
        gone = np.zeros(len(lines.doc), bool)
        for data in replies["data"].to_pylist():
            own, line = Packer.of_squeezed(data).get(np.int64).reshape(-1, 2).T
            gone[lines.first[own] + line] = True
        removed = np.r_[0, np.cumsum(gone)]
        removed = removed[lines.first[1:]] - removed[lines.first[:-1]]
        text = table["text"].to_pylist()
        for d in np.flatnonzero(removed).tolist():
            s = lines.of(d)
            text[d] = b"\n".join(lines.buf[a:b].tobytes() for a, b, x in
                                 zip(lines.begin[s], lines.end[s], gone[s]) if not x).decode()
        return pa.table([table["doc_id"].combine_chunks(), pa.array(np.diff(lines.first)), pa.array(removed),
                         pa.array(text, pa.string()), *[table[e] for e in extra]],
                        names=["doc_id", "n_lines", "n_removed", "text", *extra])

    schema = ", ".join(["doc_id long, n_lines long, n_removed long, text string",
                        *[f"{e} {fields[c]}" for e, c in zip(extra, keep)]])
    found = rounds(dealt, find, resolve, cut, decide, apply, schema)
    return found.select("doc_id", "n_lines", "n_removed", "text", *[F.col(e).alias(c) for e, c in zip(extra, keep)])
