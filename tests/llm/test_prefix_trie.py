import hashlib
import random
import zlib
from collections import defaultdict

from voxtable.llm import prefix_trie
from voxtable.llm.prefix_trie import SpillingQueue, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        below = [total[x] for x in children[node]]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        total[node] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), *total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def run(spark, rows, **more):
    table = spark.createDataFrame([(*r, 5, "z") for r in rows], SCHEMA + ", c long, k1 string")
    return sorted(str(tuple(r)) for r in conversation_trie(table, **more).collect())


def table(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(("user", "bot")), rng.choice(("a", "bé", "c" * 30))) for c in range(60) for t in range(rng.randrange(1, 14))]
    rows += [(1000 + c, t, "user", "same") for c in range(40) for t in range(6)]  # one very common conversation
    rows += [(2000, t, "user", f"long {t % 7}") for t in range(300)]
    return rows


def test_odd_rows_and_a_hot_conversation_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "BAND", 3)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 8)
    rows = table(1) + [(3, None, None, None), (3, None, None, None), (4, None, "user", "x"), (4, 0, "user", "x"), (4, 0, "bot", None), (None, 1, "user", "nobody"), (2**40 + 3, 1, "user", "far"), (507, 0, "user", "w" * 100_000), (508, 1, "", "")]
    rng = random.Random(2)
    rng.shuffle(rows)
    assert run(spark, rows, queue_rows=3) == brute(rows)


def test_empty_table_and_rows_without_conversation(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    assert run(spark, [(7, 1, "user", "x")]) == brute([(7, 1, "user", "x")])


def test_queue_gives_back_all_it_got_in_order():
    rng = random.Random(3)
    entries = [((rng.randrange(500), rng.randrange(3)), (k,)) for k in range(20_000)]
    queue = SpillingQueue(50)
    queue.PART = 7
    for key, value in entries:
        queue.push(key, value)
    want = defaultdict(list)
    for key, value in entries:
        want[key].append(value)
    for key in sorted(want):
        assert sorted(queue.pop(key)) == want[key]
    assert len(queue) == 0


def test_query_equals_brute_force_on_the_whole_table(spark):
    from voxtable.llm.queries import op13_prefix_trie

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in op13_prefix_trie(spark, sf).collect()) == brute(rows)
