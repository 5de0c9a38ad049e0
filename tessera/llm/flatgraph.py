"""A flat, robust-pruned neighbour graph over the unit vectors of one shard.

``build`` inserts nodes in doubling batches.  A batch searches the graph that
stands so far from the medoid and is compared within itself; each node keeps
the candidates that no nearer kept one dominates (robust pruning), and is
offered to them as a neighbour in return.  ``search`` is a beam search for many
queries at once; every node in range that it meets is then expanded too, until
no node in range is left unexpanded, however many there are.

Vectors are single precision here: what is found is verified in double.
"""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, ALPHA, BATCH, STEP = 24, 40, 1.2, 512, 4
PAIRS = 1 << 16


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def _cosines(x: np.ndarray, queries: np.ndarray, who: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.empty(len(who), np.float32)
    for a in range(0, len(who), PAIRS):
        out[a:a + PAIRS] = np.einsum("ij,ij->i", queries[who[a:a + PAIRS]], x[node[a:a + PAIRS]])
    return out


def _unseen(seen: np.ndarray, who: np.ndarray, near: np.ndarray):
    """(query, node) pairs not met before, each once; they count as met."""
    who = np.repeat(who, near.shape[1])
    near = near.ravel()
    take = near >= 0
    who, near = who[take], near[take]
    flat = np.unique((who.astype(np.int64) * seen.shape[1] + near)[~seen[who, near]])
    who, near = np.divmod(flat, seen.shape[1])
    seen[who, near] = True
    return who, near


def search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int = BEAM, within: float | None = None):
    """Beam (ids, cosines; best first, -1 pads) of every query, and with
    ``within`` the (queries x nodes) table of the nodes met in that range."""
    m, n = len(queries), len(x)
    seen, hit, grown = np.zeros((m, n), bool), np.zeros((m, n), bool), np.zeros((m, n), bool)
    ids, cos = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)

    def meet(who, near):
        got = _cosines(x, queries, who, near)
        if within is not None:
            close = got >= within
            hit[who[close], near[close]] = True
        return got

    def take(who, near, got):
        """The best of the beam and of the new nodes."""
        width = int(np.bincount(who, minlength=m).max(initial=0))
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        rows, at = np.unique(who, return_inverse=True)
        new_ids, new_cos = np.full((len(rows), width), -1), np.full((len(rows), width), -np.inf, np.float32)
        new_ids[at, rank], new_cos[at, rank] = near, got
        all_ids, all_cos = np.hstack([ids[rows], new_ids]), np.hstack([cos[rows], new_cos])
        all_done = np.hstack([done[rows], new_ids < 0])
        best = np.argsort(-all_cos, axis=1, kind="stable")[:, :beam]
        ids[rows], cos[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_cos, all_done))

    who, near = _unseen(seen, np.arange(m), starts)
    take(who, near, meet(who, near))
    while True:
        rows = np.flatnonzero(~done.all(axis=1))
        if not len(rows):
            break
        at = np.argsort(done[rows], axis=1, kind="stable")[:, :STEP]      # the best ones not yet expanded
        node = np.where(np.take_along_axis(done[rows], at, 1), -1, np.take_along_axis(ids[rows], at, 1))
        done[rows[:, None], at] = True
        ok = node >= 0
        grown[np.repeat(rows, ok.sum(axis=1)), node[ok]] = True
        near = np.where(ok[:, :, None], adj[node], -1).reshape(len(rows), -1)
        who, near = _unseen(seen, rows, near)
        if len(who):
            take(who, near, meet(who, near))
    while within is not None:
        who, node = np.nonzero(hit & ~grown)
        if not len(who):
            break
        grown[who, node] = True
        for a in range(0, len(who), PAIRS // 8):
            q, near = _unseen(seen, who[a:a + PAIRS // 8], adj[node[a:a + PAIRS // 8]])
            meet(q, near)
    return ids, cos, hit


def prune(x: np.ndarray, ids: np.ndarray, cos: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of each row's candidates (ids, cosines to the row's node;
    -1 pads): the nearest stays and takes out those that lie ``alpha`` times nearer
    to it than to the node; then the next."""
    out = np.full((len(ids), degree), -1)
    for a in range(0, len(ids), BATCH):
        some, far = ids[a:a + BATCH], 1 - cos[a:a + BATCH]
        live, among = some >= 0, x[some]
        for r in range(degree):
            rows = np.flatnonzero(live.any(axis=1))
            if not len(rows):
                break
            at = np.where(live[rows], far[rows], np.inf).argmin(axis=1)
            pick = some[rows, at]
            out[a + rows, r] = pick
            gap = 1 - np.einsum("ijk,ik->ij", among[rows], x[pick])
            live[rows] &= alpha**2 * gap > far[rows]
            live[rows, at] = False
    return out


def _offer(x, adj, node, to):
    """``node[i]`` becomes a neighbour of ``to[i]``; full lists are pruned anew."""
    degree = adj.shape[1]
    cos = _cosines(x, x, node, to)
    order = np.lexsort((-cos, to))
    node, to, cos = node[order], to[order], cos[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    near = rank < degree
    node, to, rank = node[near], to[near], rank[near]
    rows, at = np.unique(to, return_inverse=True)
    both = np.full((len(rows), 2 * degree), -1)
    both[:, :degree] = adj[rows]
    both[at, degree + rank] = node
    both = np.sort(both, axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    both[both == rows[:, None]] = -1
    both = -np.sort(-both, axis=1)
    full = both[:, degree] >= 0
    adj[rows[~full]] = both[~full, :degree]
    if full.any():
        cand = both[full]
        who = np.repeat(rows[full], cand.shape[1])
        far = np.where(cand >= 0, _cosines(x, x, who, np.maximum(cand, 0).ravel()).reshape(cand.shape), -np.inf)
        adj[rows[full]] = prune(x, cand, far, degree)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> np.ndarray:
    """Neighbour lists (nodes x degree, -1 pads)."""
    n = len(x)
    order = np.random.default_rng(n).permutation(n)
    mid = medoid(x) if n else 0
    order = np.concatenate([[mid], order[order != mid]]).astype(np.int64) if n else order
    adj = np.full((n, degree), -1)
    m = min(n, 1)
    while m < n:
        part = order[m:m + min(max(m, 64), BATCH)]
        ids, cos, _ = search(x, adj, x[part], np.full((len(part), 1), mid), beam)
        own = x[part] @ x[part].T
        np.fill_diagonal(own, -np.inf)
        most = min(len(part) - 1, degree)
        if most:
            at = np.argpartition(-own, most - 1, axis=1)[:, :most]
            ids, cos = np.hstack([ids, part[at]]), np.hstack([cos, np.take_along_axis(own, at, 1)])
        adj[part] = prune(x, ids, cos, degree)
        who = np.repeat(part, degree)
        to = adj[part].ravel()
        _offer(x, adj, who[to >= 0], to[to >= 0])
        m += len(part)
    return adj
