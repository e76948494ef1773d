import hashlib
import itertools
import random
import re
import zlib

from probity.llm import conversation_repair as cr

COLUMNS = "conv_id long, turn long, role string, text string"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def key_order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text.encode())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found, inserts=2):
    """Least (cost, audit, turns) over every sequence of edits with up to ``inserts`` insertions in a gap, place by place."""
    reach = {"": (0, "", ())}

    def grow(reach):
        for _ in range(inserts):
            for place, (cost, audit, turns) in list(reach.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    to = STEPS.get((place, initial))
                    if to:
                        reach[to] = min(reach.get(to, (9**9,)), (cost + 5, audit + "I", (*turns, f"{role}:")))

    for (_, role, text), fault in zip(rows, found, strict=True):
        grow(reach)
        after = {}
        for place, (cost, audit, turns) in reach.items():
            options = [(place, 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                options += [(STEPS.get((place, role[:1])), more, "K", role)]
                options += [(STEPS.get((place, r[0])), 1 + more, "R", r) for r in ("user", "assistant")]
            for to, c, letter, r in options:
                if to is not None:
                    after[to] = min(after.get(to, (9**9,)), (cost + c, audit + letter, turns + ((f"{r}:{text}",) if r else ())))
        reach = after
    grow(reach)
    return min(reach[p] for p in ("", "a") if p in reach)


def expected(rows):
    """What op13's contract gives for each conversation of ``rows``, in plain Python."""
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=key_order)
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        cost, audit, made = cheapest(own, found) if own else (0, "", ())
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def as_dict(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def made_up(seed, n_conv, most):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes", "", " \t", "No!\n", "Why? ", None, "Ok.", "a. b", "\x0b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "sys", "unknown"]
    rows = []
    for conv in [None, *range(n_conv)]:
        for k in range(rng.randrange(1, most)):
            if rng.random() < 0.4:
                role = ("user", "assistant")[k % 2] if rng.random() < 0.8 else rng.choice(roles)
                rows.append((conv, k, role, f"{rng.randrange(50)}."))
            else:
                rows.append((conv, rng.choice([None, k, k, k + 2, rng.randrange(most)]), rng.choice(roles), rng.choice(texts)))
    rows += rng.sample(rows, len(rows) // 10)
    rng.shuffle(rows)
    return rows


def test_made_up_conversations_against_plain_python(spark):
    rows = made_up(5, 150, 12)
    assert as_dict(cr.repair(cr.damaged(spark.createDataFrame(rows, COLUMNS)))) == expected(rows)


def test_long_conversations_in_small_blocks(spark):
    rows = made_up(6, 8, 400)
    docs = spark.createDataFrame(rows, COLUMNS)
    assert as_dict(cr.repair(cr.damaged(docs), block_rows=7)) == expected(rows)
    assert as_dict(cr.repair(cr.damaged(docs), block_bytes=40)) == expected(rows)


def test_query_against_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(cr.op13_conversation_repair(spark, sf_dir)) == expected(rows)


def test_edges(spark):
    assert cr.repair(spark.createDataFrame([], COLUMNS)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    lost = spark.createDataFrame([(7, gone, "user", "Hi.")], COLUMNS)
    assert as_dict(cr.repair(cr.damaged(lost))) == {7: (0, 0, 0, 0, 0, 0, "", empty)}
    hot = [(1, 0, "user", "Same.")] * 3000 + [(1, 5, "assistant", "x" * 100_000 + "!")]
    own = spark.createDataFrame([(*r, 1, "n") for r in hot], COLUMNS + ", copies long, fault string")
    got = as_dict(cr.repair(own))[1]
    assert got == (4, 0, 2999, 0, 2999, 5998, "K" + "D" * 2999 + "K", hashlib.sha256(b"user:Same.\nassistant:" + b"x" * 100_000 + b"!").hexdigest())


def test_every_split_of_a_span_gives_the_same_cell():
    rng = random.Random(2)
    for _ in range(200):
        cells = [cr.terminal(rng.choice("suat"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(2, 7))]
        full = {}
        for n in range(1, len(cells) + 1):
            for i in range(len(cells) - n + 1):
                ways = [cr.combined(full[i, k], full[k, i + n]) for k in range(i + 1, i + n)] or [cells[i]]
                assert all(w == ways[0] for w in ways)
                full[i, i + n] = ways[0]
        assert full[0, len(cells)] == cr.chart(cells)
