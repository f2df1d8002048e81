import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

from roadweave.llm import chat

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string"


def test_template_round_trip():
    rng = random.Random(3)
    parts = [*"ab\\\n<s>/[] é", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\/s>", "<|im_end|>"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        turns = [(text(3), text(9)) for _ in range(rng.randint(0, 3))]
        assert chat.parse("".join("".join(chat.format_turn(r, t)) for r, t in turns)) == turns


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n = rng.randint(1, 6)
        for t in range(n):
            role = ("user", "assistant")[t % 2]
            shared = t < 2 and c % 3 == 0
            rows.append((c, t, role, "same start </s>" if shared else f"turn {rng.randrange(4)} é [INST] {'x' * rng.randint(0, 9)}"))
    return rows


def expected(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return {k: (len(v), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest(), "".join(b for a, b in v if a == "assistant")) for k, v in out.items()}


def test_digests_and_structure(spark):
    rows = conversations()
    made = chat.sequences(spark.createDataFrame(rows, SCHEMA), VOCABULARY, PATTERN, max_tokens=150)
    got = {r.conv_id: r for r in chat.digests(made, VOCABULARY, PATTERN).collect()}
    for k, (n, turns, loss) in expected(rows).items():
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (n, turns, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shared = 0
    for s in made.collect():
        for t in s.turns:
            path, k = [], t.parent
            while k >= 0:
                path.append(s.turns[k])
                k = s.turns[k].parent
            seen = {x for p in path for x in range(p.start, p.end)}
            assert {x for i in t.sees for x in range(i.start, i.end)} == seen
            assert s.position_ids[t.start : t.end] == list(range(len(seen), len(seen) + t.end - t.start))
        assert s.turns[0].start == 0 and all(a.end == b.start for a, b in zip(s.turns, s.turns[1:]))
        kids = [t.parent for t in s.turns]
        shared += len(kids) - len(set(kids))
        # A turn stands once in its sequence.
        keys = [(t.parent, tuple(s.ids[t.start : t.end])) for t in s.turns]
        assert len(keys) == len(set(keys))
    assert shared > 0


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "first"), (None, 1, "assistant", "a"), (2, 5, "assistant", "z" * 200_000), (3, 0, "user", ""), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"said": F.lit(1), "chain": F.lit(2)})
    got = {r.conv_id: r for r in chat.digests(chat.sequences(df, VOCABULARY, PATTERN), VOCABULARY, PATTERN).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, None: 1, 2: 1, 3: 1, -7: 2}
    assert got[2].loss_chars == 200_000 and got[-7].loss_chars == 21 and got[3].loss_chars == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.sequences(empty, VOCABULARY, PATTERN).count() == 0


def test_long_conversations_are_linear(spark):
    """20,000 turns in one conversation, and a fork after each of 300 turns."""
    import time

    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(20_000)]
    rows += [(100 + c, t, "user", f"shared {t}" if t < c else f"own {c}") for c in range(40) for t in range(c + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.time()
    made = chat.sequences(df, VOCABULARY, PATTERN)
    got = {r.conv_id: r for r in chat.digests(made, VOCABULARY, PATTERN).collect()}
    assert time.time() - began < 40
    for k, (n, turns, loss) in expected(rows).items():
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars) == (n, turns, len(loss))
