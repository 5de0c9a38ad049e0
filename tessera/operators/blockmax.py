"""Best document per query within one block of postings, by block-max bounds.

A block holds the postings (document, term, weight) of some documents.  Its
documents stand in order of size, in chunks of ``CHUNK``, because weights of
documents of one size are close.  A term that many documents hold is a row of
weights of all documents with its largest weight in every chunk; the others are
lists.  A query adds its lists up.  As soon as the rows that are left cannot lift
all but a few documents of their chunks to the best sum so far, each further row
is looked up for these alone; until then it is added as a whole.  The best
document is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores this close may be equal after rounding to 6 decimals.
NEAR = 2e-6
CHUNK = 128
#: A term that one in so many documents holds is a row; cells (8 bytes) of all rows of a block.
COMMON, CELLS = 8, 8_000_000
#: Up to so many documents all rows are looked up at once.
FEW = 256
#: Up to so large numbers of terms are looked up in a table, larger ones by binary search.
DIRECT = 1 << 24


class Block:
    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int):
        self.who = np.argsort(np.bincount(doc, minlength=n_docs), kind="stable")     # place -> document
        place = np.empty(n_docs, np.int32)
        place[self.who] = np.arange(n_docs, dtype=np.int32)
        doc = place[doc]
        order = np.lexsort((doc, term))
        doc, term, weight = doc[order], term[order], weight[order]
        del order
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        if not head.all():                           # rows that share an id are one document
            first = np.flatnonzero(head)
            doc, term, weight = doc[first], term[first], np.add.reduceat(weight, first)
        self.doc, self.weight = doc, weight
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, int)
        self.terms, self.start = term[starts], np.append(starts, len(term))
        self.n_chunks = -(-n_docs // CHUNK)
        self.size = self.n_chunks * CHUNK
        df = np.diff(self.start)
        common = np.argsort(-df, kind="stable")[:CELLS // max(self.size, 1)]
        common = common[df[common] * COMMON >= n_docs]
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.held = df[common]
        self.rows = np.zeros((len(common), self.size))
        for r, t in enumerate(common.tolist()):
            self.rows[r, doc[self.start[t]:self.start[t + 1]]] = weight[self.start[t]:self.start[t + 1]]
        self.tops = self.rows.reshape(len(common), self.n_chunks, CHUNK).max(2)
        self.most = self.rows.max(1, initial=0.0)

    def best(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, sums) that may be best after rounding - of equal sums the
        first document - and the number of postings read."""
        at = np.searchsorted(self.terms, wanted)
        at[at == len(self.terms)] = 0
        at = at[self.terms[at] == wanted] if len(self.terms) else at[:0]
        return self.best_at(at)

    def best_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The same for places in ``terms``."""
        if not len(at):
            return np.zeros(0, int), np.zeros(0), 0
        row = self.row[at]
        lists, rows = at[row < 0], row[row >= 0]
        spans = [slice(a, z) for a, z in zip(self.start[lists].tolist(), self.start[lists + 1].tolist())]
        if spans:
            docs = np.concatenate([self.doc[s] for s in spans])
            total, read = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), self.size), len(docs)
        else:
            total, read = np.zeros(self.size), 0
        rows = rows[np.argsort(-self.most[rows], kind="stable")]
        rest = np.zeros((len(rows) + 1, self.n_chunks))                 # what rows from the k-th on add at most
        np.cumsum(self.tops[rows[::-1]], axis=0, out=rest[-2::-1])
        live, least = None, 0.0
        for k, r in enumerate(rows.tolist()):
            if live is None:
                peak = int(total.argmax())
                least = max(least, total[peak] + self.rows[rows[k:], peak].sum()) if read else least
                grid, need = total.reshape(-1, CHUNK), least - NEAR - rest[k]
                chunks = np.flatnonzero(grid.max(1) >= need)
                if read and len(chunks) * 4 <= self.n_chunks:
                    i, j = np.nonzero(grid[chunks] >= need[chunks, None])
                    some = chunks[i] * CHUNK + j
                elif read:
                    some = np.flatnonzero(grid >= need[:, None])
                if read and len(some) < self.held[r] and len(some) * 8 <= self.size:
                    live, sums = some, total[some]
                else:
                    total += self.rows[r]
                    read += int(self.held[r])
                    continue
            if len(live) <= FEW:
                sums = sums + self.rows[rows[k:, None], live].sum(0)
                read += int(min(len(live), self.held[r])) * (len(rows) - k)
                break
            sums = sums + self.rows[r, live]
            read += int(min(len(live), self.held[r]))
            least = max(least, sums.max())
            keep = sums + rest[k + 1, live // CHUNK] >= least - NEAR
            live, sums = live[keep], sums[keep]
        if live is None:
            live = np.flatnonzero(total >= max(total.max() - NEAR, 0.0))
            sums = total[live]
        some = (sums > 0) & (sums >= sums.max() - NEAR)
        docs, sums = self.who[live[some]], sums[some]
        if len(docs) > 1:
            order = np.argsort(docs)
            docs, sums = docs[order], sums[order]
            _, first = np.unique(sums, return_index=True)
            first.sort()
            docs, sums = docs[first], sums[first]
        return docs, sums, read


def best_by(n_docs: int, avgdl: float, k1: float, b: float):
    """The function of a (block, batch) group, for a corpus of ``n_docs`` rows of ``avgdl`` tokens."""

    def best_of_block(postings: pa.Table, queries: pa.Table) -> pa.Table:
        """(qid, doc, score) candidates of a block: rows (doc, dl, t, tf) of numbers and
        counts of terms, queries (qid, t, df) of numbers and document counts of terms."""
        qid, docs = queries.column("qid").combine_chunks(), postings.column("doc").combine_chunks()
        ends, wanted, df = _flat(queries, "t", "df")
        names, first, wanted = np.unique(wanted, return_index=True, return_inverse=True)
        idf = np.log(1.0 + (n_docs - df[first] + 0.5) / (df[first] + 0.5))
        # documents in the order of their ids
        order = pc.array_sort_indices(docs)
        ids = docs.take(order).dictionary_encode()
        code = np.empty(len(docs), np.int32)
        code[order.to_numpy()] = ids.indices.to_numpy()
        starts, term, tf = _flat(postings, "t", "tf")
        held = np.diff(starts)
        term, met = _numbers(names, term)
        rest = np.repeat(k1 * (1 - b + b * postings.column("dl").to_numpy() / avgdl), held)
        doc = np.repeat(code, held)
        if not met.all():
            term, tf, rest, doc = term[met], tf[met], rest[met], doc[met]
        rest += tf
        weight = idf[term]
        weight *= tf
        weight *= k1 + 1
        weight /= rest
        del rest, tf, met, starts, held
        block = Block(doc, term, weight, len(ids.dictionary))
        del doc, term, weight
        at = np.full(len(names) + 1, -1)
        at[block.terms] = np.arange(len(block.terms))
        at = at[wanted]
        who, found, scores = [], [], []
        for k, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            own = at[a:z]
            some, total, _ = block.best_at(own[own >= 0])
            who.append(np.full(len(some), k))
            found.append(some)
            scores.append(total)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"qid": qid.take(pa.array(cat(who, np.int64), pa.int64())),
                         "doc": ids.dictionary.take(pa.array(cat(found, np.int64), pa.int64())), "score": pa.array(cat(scores, np.float64))})

    return best_of_block


def _flat(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets and values of list columns of equal lengths."""
    lists = [table.column(c).combine_chunks() for c in names]
    sizes = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes, dtype=np.int64)), *(x.flatten().to_numpy() for x in lists)


def _numbers(names: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of terms in the sorted ``names``, and which of them are there."""
    if not len(names):
        return np.zeros(len(term), np.int32), np.zeros(len(term), bool)
    if names[-1] < DIRECT:
        table = np.full(max(int(names[-1]), int(term.max(initial=0))) + 1, -1, np.int32)
        table[names] = np.arange(len(names))
        at = table[term]
        return at, at >= 0
    at = np.searchsorted(names, term).astype(np.int32)
    at[at == len(names)] = 0
    return at, names[at] == term


def token_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows (doc, _toks) of some batches as tables of up to ``most`` tokens; a longer row is alone."""
    waiting, held = [], 0
    for batch in batches:
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_toks")), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
        start = 0
        while start < len(batch):
            stop = int(np.searchsorted(ends, ends[start] + most - held, "right")) - 1
            if stop > start:
                waiting.append(batch.slice(start, stop - start))
                held += int(ends[stop] - ends[start])
                start = stop
            elif not waiting:
                waiting.append(batch.slice(start, 1))
                start += 1
                held = most
            if start < len(batch) or held >= most:
                yield pa.Table.from_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def count_terms(rows: pa.Table, known: pa.Array, numbers: np.ndarray) -> pa.Table:
    """(doc, dl, n_rows, t, tf) of rows (doc, _toks): the number of tokens, and the numbers
    and counts of those that are ``known``.  A row without an id or tokens has no lists."""
    docs, toks = rows.column("doc").combine_chunks(), rows.column("_toks").combine_chunks()
    dl = pc.list_value_length(toks).cast(pa.int32())
    sizes = pc.fill_null(dl, 0).to_numpy(zero_copy_only=False)
    found = pc.fill_null(pc.index_in(toks.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    use = (found >= 0) & docs.is_valid().to_numpy(zero_copy_only=False)[row]
    key, tf = np.unique(row[use] * len(known) + found[use], return_counts=True)
    row, at = np.divmod(key, max(len(known), 1))
    ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
    return pa.table({"doc": docs, "dl": dl, "n_rows": pa.array(np.ones(len(sizes), np.int64)),
                     "t": pa.ListArray.from_arrays(ends, pa.array(numbers[at])), "tf": pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))})
