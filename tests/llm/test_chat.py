import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import chat, queries
from tests.oracle import assert_matches

LOG = "conv_id long, seq long, kind string, message string, role string, text string, at int, loss string"
TURNS = "conv_id long, turn long, role string, text string, alone int"


def brute(events):
    """The fold, event by event."""
    key = lambda e: tuple((x is not None, x) for x in (e[1], e[3], e[2], e[4], e[5]))
    out = {}
    for conv in {e[0] for e in events}:
        messages, begun, dropped = {}, {}, set()
        for n, e in enumerate(sorted((e for e in events if e[0] == conv), key=key)):
            kind, name, role, text = e[2], e[3] if e[3] is not None else n, e[4], e[5] or ""
            if kind not in ("message", "delta", "edit", "regenerate"):
                continue
            begun.setdefault(name, n)
            old = messages.get(name, (None, ""))
            messages[name] = (role if role is not None else old[0], old[1] + text if kind == "delta" else text)
            if kind == "regenerate":
                dropped |= {m for m, at in begun.items() if at > begun[name]}
        out[conv] = [(messages[m][0] or "", messages[m][1]) for m in sorted(messages, key=begun.get) if m not in dropped]
    return {c: m for c, m in out.items() if m}


def rendered(spark, events):
    return chat.render(chat.fold(spark.createDataFrame([(*e, 1, "x") for e in events], LOG)))


def test_against_sql(spark, sf_dir):
    assert_matches(spark, queries.op12_chat, chat.SQL, sf_dir)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op12_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, "message", "u", "user", "Hi"), (1, 1, "message", "a", "assistant", ""), (1, 2, "delta", "a", None, "Hel"), (1, 3, "delta", "a", None, "lo"),
        (1, 4, "message", "v", "user", "More?"), (1, 5, "edit", "v", None, "Again?"), (1, 6, "message", "b", "assistant", "No"), (1, 7, "regenerate", "a", None, None),
        (1, 8, "delta", "a", None, "Good "), (1, 9, "delta", "b", None, "late"), (1, 10, "delta", "a", None, "day"), (1, 11, "typing", "a", None, "?"), (1, 12, "message", "w", "user", "Bye"),
    ]
    got = [(r.role, r.text) for r in chat.fold(spark.createDataFrame([(*e, 1, "x") for e in events], LOG)).orderBy("at").collect()]
    assert got == [("user", "Hi"), ("assistant", "Good day"), ("user", "Bye")] == brute(events)[1]


def test_against_brute_force(spark):
    rng, events = random.Random(3), []
    for _ in range(1500):
        events.append((rng.choice([1, 2, 3, 4, None, 6]), rng.choice([*range(60), None]), rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "other"]), rng.choice([*"abcdefghijkl", None]),
                       rng.choice(["user", "assistant", None, "<r>\\"]), rng.choice(["", None, "x", "é<", "\\l", "\\", "</turn>\n", ">\\b", "日本"])))
    out = rendered(spark, events)
    want = brute(events)
    rows = out.select("conv_id", "formatted", "loss", chat.parsed(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in rows} == want
    for r in rows:
        assert r.learned == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        cut = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert cut == [t.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g") for role, t in want[r.conv_id] if role == "assistant"]
        assert r.formatted.count(chat.SHUT) == len(want[r.conv_id]) == r.formatted.count(chat.OPEN)


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "<", ">", "\\l", "\\\\l", "\\b<\\g>", "</turn>\n<turn assistant>", "a\n\tb", "\\\\\\", chat.PLANTED]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).select("t", "e", chat.unescaped(F.col("e")).alias("back"))
    for r in df.collect():
        assert r.back == r.t and "<" not in r.e and ">" not in r.e


def test_odd_turns(spark):
    turns = [(1, 0, "user", None, 1), (1, 0, "user", None, 2), (None, None, None, None, 3), (None, 1, "assistant", "x" * 300_000 + "<", 4), (2, 5, "assistant", "", 5), (2, 5, "assistant", "b", 6), (2, 5, "assistant", "b", 7), (2, 4, "", "first", 8)]
    out = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.turn_log(spark.createDataFrame(turns, TURNS))))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 2 and out[1].turns_sha256 == sha("user\n\nuser\n\n") and out[1].loss_chars == 0 and out[1].loss_sha256 == sha("")
    assert out[None].turns_sha256 == sha("\n\nassistant\n" + "x" * 300_000 + "<\n") and out[None].loss_chars == 300_001
    assert out[2].turns_sha256 == sha("\nfirst\nassistant\n\nassistant\nb\nassistant\nb\n") and out[2].loss_sha256 == sha("bb")
    assert chat.digests(chat.render(chat.fold(chat.turn_log(spark.createDataFrame([], TURNS))))).collect() == []
