"""Conversation repair against an exhaustive search over all edits."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, audit string, n string"
WS = r"\x20\x09-\x0D"


def expected(rows):
    """The contract by plain Python, conversation by conversation."""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        name = lambda x: " " if x is None else str(x)
        after = []
        for turn, role, text in own:
            f = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
            if f == 0:
                continue
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            after += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, seen = [], set()
        for _, role, text in after:
            bare = re.sub(f"[{WS}]+$", "", text)
            kinds.append("blank" if not bare else "dup" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in after if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        n = len(after)

        @lru_cache(maxsize=None)
        def best(i, state, inserted):
            options = []
            if i == n and state in "0a":
                options.append((0, "", ()))
            nxt = "a" if state == "u" else "u"
            if inserted < 3:
                c, s, w = best(i, nxt, inserted + 1)
                options.append((c + 3, "I" + s, (("I", nxt),) + w))
            if i < n:
                extra = 3 * (kinds[i] == "cut")
                c, s, w = best(i + 1, state, 0)
                options.append((c + 4, "D" + s, (("D", ""),) + w))
                if kinds[i] not in ("blank", "dup"):
                    c, s, w = best(i + 1, nxt, 0)
                    options.append((c + 3 + extra, "R" + s, (("R", nxt),) + w))
                    r = after[i][1][:1]
                    if r == nxt or (r == "s" and state == "0"):
                        c, s, w = best(i + 1, r, 0)
                        options.append((c + extra, "K" + s, (("K", ""),) + w))
            return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())
        for i in range(n, -1, -1):  # from the end, so that no call goes deep
            for state in "0sua":
                best(i, state, 0)
        cost, audit, how = best(0, "0", 0)
        full, lines, i = {"u": "user", "a": "assistant"}, [], 0
        for e, role in how:
            if e == "I":
                lines.append(full[role] + ":")
                continue
            _, own_role, text = after[i]
            i += 1
            if e != "D":
                lines.append((own_role if e == "K" else full[role]) + ":" + text)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "dup", "cut")),
                     illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def fixture():
    rng = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "sys", "unknown", "aide"]
    texts = ["Fine.", "What?", "No end", "", " \t\n", None, "Ends. \n", "a.b!c?", "é ü.", "x" * 5000 + "."]
    rows = []
    for conv in range(1, 120):
        for t in range(int(rng.integers(1, 12))):
            text = texts[rng.integers(len(texts))]
            rows.append((conv, int(t), roles[rng.integers(len(roles))], text if rng.random() < .3 else f"{conv}.{t} {text}", "z", "z"))
    rows += [(None, t, "user", "same.", "z", "z") for t in range(9)]
    rows += [(7, None, r, "null turn", "z", "z") for r in ("user", "assistant", None)]
    rows += [(500, 3, "user", "again.", "z", "z")] * 6 + [(501, None, "user", "again.", "z", "z")] * 3
    rows += [(600, t, ("user", "assistant")[t % 2], f"turn {t % 40}" + "." * (t % 7 > 0), "z", "z") for t in range(900)]
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "gone.", "z", "z")]


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_repair_matches_exhaustive_search(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = fixture()
        result = got(dialogue.repair(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert result == expected(rows)


def test_repair_of_nothing(spark):
    df = dialogue.repair(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["conv_id", *dialogue.COUNTS, "audit", "repaired_sha256"] and df.count() == 0


def test_block_tables_equal_single_steps():
    t = dialogue.tables()
    assert len(t.vectors) < 200 and t.block_to.shape[0] == dialogue.N_SYMBOLS ** dialogue.BLOCK
    rng = np.random.default_rng(3)
    for _ in range(50):
        syms = bytes(rng.integers(0, dialogue.N_SYMBOLS, int(rng.integers(0, 40))).tolist())
        for v, end in enumerate(t.maps(syms)):
            at, vec = v, t.vectors[v]
            for s in reversed(syms):
                at, vec = int(t.to[s, at]), dialogue._before(s, vec)
            low = min(vec)
            assert at == end and t.vectors[at] == tuple(x - low for x in vec)


def test_damage_keeps_equal_rows_as_one_with_a_count(spark):
    rows = [(500, 3, "user", "again.", "z", "z")] * 6
    assert dialogue.damage(spark.createDataFrame(rows, SCHEMA)).agg(F.count("*")).first()[0] <= 1
