import hashlib
import random
import zlib

import numpy as np
import pytest

from kdframe.llm import prefix_trie as pt
from kdframe.session import materialize


def conversations(rows):
    """The ordered turns of each conversation, from (conv_id, turn, role, text)."""
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = sum(len(n) == len(node) + 1 for n in below)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes) for n in below)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(node))))
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(rng, n=70):
    rows = []
    for c in rng.sample(range(1000), n):
        length = rng.choice([0, 1, 2, 3, 5, 8, 40])
        for turn in range(length):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", "é", None] if turn < 6 else ["z"])))
    for copy in (1000, 1001, 1100, 1200):  # copies, of which some borrow their heads
        rows += [(copy, turn, role, text) for c, turn, role, text in rows if c == rows[0][0]]
    rng.shuffle(rows)
    return rows


def spread(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def collected(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*names).collect()), key=str)


@pytest.mark.parametrize("block, shard", [(12, 1 << 20), (2, 3)])
def test_against_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(pt, "BLOCK_BITS", block)
    monkeypatch.setattr(pt, "SHARD_NODES", shard)  # in the driver; tasks have the default
    rng = random.Random(13)
    rows = [*table(rng), (5, None, "user", "first"), (5, 0, "user", "second"), (None, 0, "user", "lost"), (-7, 3, None, None), (-7, 3, None, None)]
    turns = materialize(pt.ranked_turns(spread(spark, rows)))
    convs = conversations(rows)
    assert collected(pt.trie(turns, pt.lengths(turns))) == brute(convs)
    again = {c: t for c, t in rebuilt({c: t for c, t in convs.items() if c >= 0}).items()}
    positive = turns.where("conv >= 0")
    found = collected(pt.trie(*pt.with_borrowed_heads(positive)))
    assert found == brute(again)
    assert any(not t for t in again.values()) and max(r[3] for r in found[1:]) > 3


def test_empty_and_turnless(spark):
    none = spread(spark, [(1, 0, "user", "x")]).limit(0)
    turns = materialize(pt.ranked_turns(none))
    assert collected(pt.trie(*pt.with_borrowed_heads(turns))) == []
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    turns = materialize(pt.ranked_turns(spread(spark, [(alone, 0, "user", "x")])))
    digest = hashlib.sha256(str(alone).encode()).hexdigest()
    assert collected(pt.trie(*pt.with_borrowed_heads(turns))) == [(alone, 0, None, 1, 0, 1, 0, digest)]


def test_parentheses(monkeypatch):
    rng = random.Random(2)
    for block in (1, 2, 7, 512):
        monkeypatch.setattr(pt, "EXCESS_BLOCK", block)
        for size in (1, 2, 50, 400):
            opens, depth, left = [], 0, size
            while left or depth:
                up = left and (not depth or rng.random() < 0.55)
                opens.append(bool(up))
                depth, left = depth + (1 if up else -1), left - bool(up)
            stack, close = [], {}
            for at, up in enumerate(opens):
                if up:
                    stack.append(at)
                else:
                    close[stack.pop()] = at
            found = pt.Parentheses(np.array(opens))
            assert {at: found.findclose(at) for at in close} == close
            assert found.leaf_pairs().tolist() == [a for a in sorted(close) if close[a] == a + 1]


def test_shards_share_spines():
    """However paths are dealt to shards, the parts of a node add up."""
    rng = random.Random(4)
    convs = {c: [rng.choice("ab") for _ in range(rng.randrange(1, 9))] for c in range(200)}
    nodes = {}
    for c, turns in convs.items():
        for d in range(1, len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    inner = {n[:-1] for n in nodes}
    firsts = {}
    for c, turns in convs.items():
        firsts.setdefault(tuple(turns), c)
    paths = []
    for turns, c in firsts.items():
        own = [turns[:d] for d in range(1, len(turns) + 1)]
        paths.append((c, [{"depth": len(n), "owner": min(nodes[n]), "n_convs": len(nodes[n]), "upto": len(n), "leaf": n not in inner} for n in own]))
    paths.sort(key=lambda p: [(x["owner"], x["depth"]) for x in p[1]])
    totals = []
    for step in (1, 3, 1000):
        total = {}
        for at in range(0, len(paths), step):
            shard = pt.Shard()
            for c, path in paths[at : at + step]:
                shard.add(c, path)
            for row in shard.sums().to_pylist():
                old = total.get((row["conv"], row["depth"]), (0, 0))
                total[row["conv"], row["depth"]] = (old[0] + row["n_leaves"], old[1] + row["saved"])
        totals.append(total)
    assert totals[0] == totals[1] == totals[2] and len(totals[0]) == len(nodes) + 1
