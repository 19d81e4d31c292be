import hashlib
import random
import zlib
from collections import Counter, defaultdict

import helpers as h
import pytest

from tickerpress.llm import conversation_repair, prefix_trie
from tickerpress.llm.queries import op12_conversation_repair, op13_prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def order(row, fill):
    return (row[1] is not None, row[1] or 0, row[2] if row[2] is not None else fill, row[3] if row[3] is not None else fill)


# ---- repair

def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(rows):
    """Whole scripts of all states, row by row, with nothing forgotten."""
    rows = sorted(rows, key=lambda r: order(r, " "))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best, seen, faults, initials = {"": (0, "", [])}, set(), Counter(), []

    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    to = step.get((state, initial))
                    new = (cost + 3, audit + "I", out + [f"{role}:"])
                    if to is not None and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    for _, _, role, text in rows:
        body = text.rstrip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        initials.append(role[:1])
        after = {}

        def offer(state, new):
            if state is not None and (state not in after or new[:2] < after[state][:2]):
                after[state] = new

        # All inserts before a row at once, so that a state may be left on both the old and the new script.
        for start, one in best.items():
            for state, (cost, audit, out) in inserts({start: one}).items():
                offer(state, (cost + 4, audit + "D", out))
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 if fault else 0
                offer(step.get((state, role[:1])), (cost + more, audit + "K", out + [f"{role}:{text}"]))
                for initial, given in (("u", "user"), ("a", "assistant")):
                    offer(step.get((state, initial)), (cost + more + 3, audit + "R", out + [f"{given}:{text}"]))
        best = after
    full = inserts(best)
    cost, audit, out = min((full[s] for s in ("", "a") if s in full), key=lambda x: x[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_reports(rows):
    by_conv = {r[0]: [] for r in rows}
    for r in harmed(rows):
        by_conv[r[0]].append(r)
    return {conv: brute_repair(rs) for conv, rs in by_conv.items()}


def random_rows(r, convs, longest, texts=("Yes.", "No", "Why?", "", " \n", "Go on!", "and", ". ", "x ")):
    roles = ("user", "assistant", "user", "assistant", "system", "tool", "", None)
    out = []
    for conv in convs:
        for turn in range(r.randrange(1, longest)):
            text = r.choice(texts)
            if text and text.strip() and r.random() < 0.7:
                text = f"{turn} {text}"
            role = ("user", "assistant")[turn % 2] if r.random() < 0.6 else r.choice(roles)
            out.append((conv, None if r.random() < 0.03 else turn, role, None if r.random() < 0.03 else text))
    return out


def run_query(spark, query, rows, tmp_path):
    spark.createDataFrame(rows, TURNS).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return query(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("seed", range(3))
def test_reports_like_brute_force(spark, tmp_path, seed):
    rows = random_rows(random.Random(seed), [None, *range(250)], 14)
    got = {r[0]: tuple(r[1:]) for r in run_query(spark, op12_conversation_repair, rows, tmp_path)}
    assert got == brute_reports(rows)


def test_a_conversation_in_many_pieces(spark, tmp_path):
    """One conversation holds most rows; ranges cut it, and every piece is searched on its own."""
    rows = random_rows(random.Random(8), range(20), 10) + [r for r in random_rows(random.Random(9), [77] * 12, 300)]
    rows += [(77, 5, "user", "same.")] * 200 + [(78, 1, "user", "")] * 100 + [(None, 3, None, None)] * 50
    rows += [(90, t, "user", f"{t}.") for t in range(400)] + [(91, t, "tool", f"{t}") for t in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        frame = conversation_repair.damage(spark.createDataFrame(rows, TURNS))
        edits = conversation_repair.repair(frame).collect()
        got = {r[0]: tuple(r[1:]) for r in run_query(spark, op12_conversation_repair, rows, tmp_path)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_reports(rows)
    assert len({e.part for e in edits if e.conv_id == 77}) > 2


def test_edits_hold_rows_and_roles(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "So")]
    edits = sorted(conversation_repair.repair(spark.createDataFrame(rows, TURNS)).collect(), key=lambda e: (e.part, e.seq))
    assert [(e.edit, e.role, e.old_role, e.text, e.fault) for e in edits] == [
        ("I", "user", None, "", None), ("K", "assistant", "assistant", "Hello.", None), ("K", "user", "user", "Hi.", None),
        ("D", None, "user", None, "duplicate"), ("K", "assistant", "assistant", "So", "truncated")]


def test_repair_of_extra_columns_long_texts_and_nothing(spark):
    long = "word " * 400_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Yes.")]
    frame = h.clashing(spark.createDataFrame(rows, TURNS)).drop("times")
    report = conversation_repair.report(conversation_repair.repair(frame)).first()
    assert (report.audit, report.cost) == ("KK", 0)
    assert report.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.repaired(empty, empty).count() == 0
    lost = conversation_repair.repaired(empty, spark.createDataFrame(rows, TURNS)).first()
    assert tuple(lost) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_decoder_holds_little_and_forgets_branches():
    """On a usual conversation the survivors meet again and again; on any, all open nodes hang on survivors."""
    r = random.Random(4)
    decoder, given, most = conversation_repair.Decoder(0), 0, 0
    for i in range(20_000):
        broken = r.random() < 0.05
        given += len(decoder.feed("ua"[i % 2] if r.random() < 0.9 else r.choice("usx"), r.random() < 0.05, broken, i))
        most = max(most, i + 1 - given)
    assert most <= 3 * conversation_repair.PATIENCE
    steps, _ = decoder.finish(None)
    assert given + len(steps) == 20_000


# ---- trie

def brute_trie(rows):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: order(r, "")):
        own[r[0]].append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c in own:
        head = zlib.crc32(str(c).encode()) % 6
        lender = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(lender, [])[:head] + own[c][head:])
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, convs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(p)))
        out.append((min(convs), len(p), min(nodes[p[:-1]]) if p else None, len(convs), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, tmp_path):
    return sorted((tuple(r) for r in run_query(spark, op13_prefix_trie, rows, tmp_path)), key=str)


def chatter(r, convs, longest, words=3):
    return [(c, None if r.random() < 0.05 else t, r.choice(("user", "assistant", None)), r.choice(("", None, *"abc"[:words], "é日")))
            for c in convs for t in range(r.randrange(0, longest))]


@pytest.mark.parametrize("seed", range(2))
def test_trie_like_brute_force(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = chatter(r, [*range(0, 130), *range(200, 212), *range(-205, -190), 905], 9, 2)
    rows += rows[:30] + [(None, 1, "user", "x")] * 3
    assert trie(spark, rows, tmp_path) == brute_trie(rows)


def test_trie_in_segments(spark, tmp_path, monkeypatch):
    """Sequences of several segments, whole and cut, share the nodes of the turns they share."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    base = [("user", f"t{i}") for i in range(40)]
    rows = []
    for c, n in zip(range(300, 330), [40, 40, 33, 32, 31, 16, 17, 15, 8, 4, 3, 1, 2, 5, 6, 7, 9, 12, 20, 24, 28, 36, 39, 11, 10, 13, 14, 18, 19, 21]):
        rows += [(c, i, role, text if (c % 5 or i < 11) else text + "!") for i, (role, text) in enumerate(base[:n])]
    assert trie(spark, rows, tmp_path) == brute_trie(rows)


def test_trie_of_a_long_conversation(spark, tmp_path):
    rows = [(c, i, "user", f"t{i % 7}") for c, n in ((0, 2500), (1, 2500), (2, 1030), (3, 1024), (5, 1)) for i in range(n)]
    got = trie(spark, rows, tmp_path)
    want = brute_nodes_of_chains(rows)
    assert Counter(x[:5] for x in got) == Counter(want)
    root = next(x for x in got if x[1] == 0)
    assert root[3] == 5 and root[5] == sum(x[4] == 0 for x in got)


def brute_nodes_of_chains(rows):
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    nodes, last = defaultdict(list), {}
    for c in own:
        head = zlib.crc32(str(c).encode()) % 6
        name = b""
        nodes[(0, name)].append(c)
        for d, turn in enumerate(own[0][:head] + own[c][head:], 1):
            up, name = (d - 1, name), hashlib.md5(name + repr(turn).encode()).digest()
            nodes[(d, name)].append(c)
            last[(d, name)] = up
    children = Counter(last.values())
    return [(min(cs), k[0], min(nodes[last[k]]) if k in last else None, len(cs), children[k]) for k, cs in nodes.items()]


def test_trie_of_repeats_extra_columns_and_nothing(spark, tmp_path):
    rows = [(4, 1, "user", "Hi.")] * 3 + [(4, None, "user", "x" * 300_000)] + [(9, 1, "user", "Hi.")] * 9
    assert trie(spark, rows, tmp_path) == brute_trie(rows)
    frame = h.clashing(spark.createDataFrame(rows, TURNS)).withColumn("depth", prefix_trie.F.lit("mine"))
    assert prefix_trie.build_trie(prefix_trie.rebuilt_turns(frame)).count() == len(brute_trie(rows))
    assert trie(spark, [(None, 1, "user", "x")], tmp_path) == []
