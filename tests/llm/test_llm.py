"""The training-data operators against brute force, round trips and edge cases."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.common import words
from textloom.llm import p1_scans as P1
from textloom.llm import p2_near as P2
from textloom.llm import p3_pairs as P3
from textloom.llm import p4_conversations as P4
from textloom.llm import p5_pieces as P5
from textloom.llm import p6_neighbours as P6
from textloom.llm import p7_containers as P7
from textloom.llm import p8_leaks as P8
from textloom.llm import p9_residue as P9
from textloom.llm.hnsw import Hnsw

CHAT = "id long, session_id string, role string, content string, created_at timestamp, chunk_text string"
T0 = datetime(2024, 1, 1)


def chat(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], CHAT)


# --- 1 -----------------------------------------------------------------------------------------------------

CLEAN = "The planner reaches better answers because the entity remains in the section. Human judges preferred the discrete chunker when the corpus is small."


def corpus():
    rows = [(f"c{i}", CLEAN + f" Run {i} of the corpus.") for i in range(60)]
    rows += [
        ("hyph", CLEAN + " The plan-\nner reaches the enti- ty."),
        ("soft", CLEAN + " The re­\nmains of it."),
        ("mis", CLEAN + " The p1anner reaclies the enfity and the c h u n k e r remams."),
        ("head", "Human judges preferred the discrete\nPreprint. Under review at Paend 2016.\n\nchunker when the corpus is small."),
        ("page", "Human judges preferred the discrete\n \n- 31 -\n\nchunker when the corpus is small."),
        ("both", "Human judges preferred the 17    S T E N D   R E P O R T discrete chunker when the corpus is small."),
        ("clean_table", "Human judges preferred it.\nSystem\nSize\nhit rate\nDeibiakMem\n5\n0.11\nIn practice the corpus is small."),
        ("clean_compound", "With pre- and post-filtering the corpus is small; a tool-\nusing planner."),
        ("empty", ""),
        ("long", CLEAN * 500),
    ]
    return rows


def test_p1_kinds_and_repair(spark):
    rows = corpus() + [(f"t{i}", "a tool-using planner and a tool-using chunker") for i in range(20)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows] + [(None, "x", "x"), ("null", None, "x"), rows[60] + ("x",)], "chunk_id string, chunk_text string, noise string")
    got = defaultdict(set)
    for r in P1.noise_kinds(df).collect():
        got[r["chunk_id"]].add(r["noise"])
    assert got == {"hyph": {"hyphenation"}, "soft": {"hyphenation"}, "mis": {"misread"}, "head": {"header"}, "page": {"page_number"}, "both": {"header", "page_number"}}
    out = {r["chunk_id"]: r["chunk_text"] for r in P1.repaired(df).collect()}
    assert set(out) == set(got)
    assert out["head"] == out["page"] == out["both"] == "Human judges preferred the discrete chunker when the corpus is small."
    assert out["mis"].endswith("The planner reaches the entity and the chunker remains.") and out["hyph"].endswith("The planner reaches the entity.")
    assert P1.noise_kinds(df.limit(0)).count() == 0


def test_p1_recurrent_misreadings_are_no_words(spark):
    clean = [(f"c{i}", "every reward stays while the scarce data is new") for i in range(100)]
    hurt = [(f"h{i}", "evcry rewɑrd stay5 whi|e the scarce data is new") for i in range(6)]
    df = spark.createDataFrame(clean + hurt, "chunk_id string, chunk_text string")
    assert {tuple(r) for r in P1.noise_kinds(df).collect()} == {(k, "misread") for k, _ in hurt}
    assert {r["chunk_text"] for r in P1.repaired(df).collect()} == {clean[0][1]}


def test_p1_learned_headers_of_damaged_texts(spark):
    clean = [(f"c{i}", CLEAN) for i in range(60)]
    # An unlisted header, mid-sentence with hyphenation beside it or inside its word, or after a full stop.
    hurt = [(f"m{i}", f"Human jud-\nges preferred the discrete\n\nStudies of Remote Libraries {i}\n\nchunker when the corpus is small.") for i in range(3)]
    hurt += [("w", "Human judges preferred the discrete chun-\n\nStudies of Remote Libraries 7\n\nker when the corpus is small.")]
    hurt += [("flat", "Human jud-\nges preferred the discrete Studies of Distant Archives 12 chunker when the corpus is small.")]  # another name, and no line of its own
    stop = ("s", CLEAN + "\n\nStudies of Remote Libraries 8\n\n" + CLEAN)
    df = spark.createDataFrame([*clean, *hurt, stop, ("other", CLEAN + "\n\nSections of Another Report 8\n\n" + CLEAN)], "chunk_id string, chunk_text string")
    got = {tuple(r) for r in P1.noise_kinds(df).collect()}
    assert got == {(k, n) for k, _ in hurt for n in ("header", "hyphenation")} | {("s", "header")}
    out = {r["chunk_id"]: r["chunk_text"] for r in P1.repaired(df).collect()}
    assert {out[k] for k, _ in hurt} == {"Human judges preferred the discrete chunker when the corpus is small."}
    assert "Libraries" not in out["s"]


def test_p1_inline_page_numbers_of_several_lines():
    rows = [(w, P1.skeleton(w), 100, 0, 0) for w in "the planner itself jointly reaches better answers because entity remains in section".split()]
    lex = P1.Lexicon(rows, 5)
    first = "the planner reaches better answers because the\n"
    for bad in ("the planner itself 4 jointly reaches", "the planner itself p. 12 jointly reaches", "the planner itself 12/30 jointly reaches", "the planner itself jointly 7\nreaches better answers in section"):
        r = P1.Repair(first + bad, lex)
        assert r.noise == {"page_number"} and not any(c.isdigit() for x in r.lines for c in x), bad
    for fine in ("- the planner itself 4 jointly reaches", "    planner = the itself 4 jointly reaches", "```\nthe planner itself 4 jointly reaches\n```", "itself 4 jointly", "| the planner itself 4 jointly reaches |"):
        assert P1.Repair(first + "\n" + fine, lex).noise == set(), fine


def test_p1_derivable():
    assert P1.derivable("planner", "p1anner") and P1.derivable("remains", "remams") and not P1.derivable("train", "tiarn") and not P1.derivable("same", "same")


# --- 2 -----------------------------------------------------------------------------------------------------


def near_rows(rng, n=60):
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(n):
        base = [rng.choice(vocabulary) for _ in range(80)]
        rows.append((f"d{d}", " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 3])):
            own = list(base)
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(80)] = rng.choice(vocabulary)
            rows.append((f"d{d}e{k}", " ".join(own).upper() if k else ", ".join(own)))
    return rows


def brute_pairs(rows):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = set(zip(w, w[1:], w[2:]))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def test_p2_pairs_and_groups(spark):
    rows = near_rows(random.Random(5)) + [("x1", "one two three four"), ("x2", "One two, three four!"), ("s", "two words"), ("e", "")]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows] + [("n", None, "z"), (None, "one two three four", "z"), rows[0] + ("z",)], "chunk_id string, chunk_text string, doc string")
    members, pairs = P2.near_pairs(df)
    got = {tuple(r) for r in P2.expand(members, pairs).collect()}
    assert got == brute_pairs(rows)
    assert P2.near_pairs(df.limit(0))[1].count() == 0


def test_p2_hot_postings_are_salted(spark, monkeypatch):
    rows = near_rows(random.Random(6))
    monkeypatch.setattr(P2, "HOT", 2)
    monkeypatch.setattr(P2, "POSTINGS", 500)
    members, pairs = P2.near_pairs(spark.createDataFrame(rows, "chunk_id string, chunk_text string"))
    assert {tuple(r) for r in P2.expand(members, pairs, None).collect()} == brute_pairs(rows)


def test_p2_large_class_of_copies_is_a_star(spark):
    df = spark.createDataFrame([(f"k{i:03}", "the very same text of some words") for i in range(100)] + [("y", "the very same text of some words here")], "chunk_id string, chunk_text string")
    members, pairs = P2.near_pairs(df)
    got = {tuple(r) for r in P2.expand(members, pairs, limit=10).collect()}
    assert got == {("k000", f"k{i:03}") for i in range(1, 100)} | {("k000", "y")}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.range(41).select(F.col("id").alias("node"))
    assert {r["component"] for r in P2.components(chain, nodes).collect()} == {0}


# --- 3 and 4 -------------------------------------------------------------------------------------------------

Q = "Which planners does the corpus need for table lookup?"
A = "The planner needs 12 tables when the corpus is small."


@pytest.mark.parametrize(
    "prompt, reply, want",
    [
        (Q, A, None), (Q, None, "empty"), (Q, " N/A ", "empty"), (Q, "…", "empty"), (Q, "[no response]", "empty"),
        (Q, Q, "copied_question"), (Q, f'"{Q.upper()}"', "copied_question"), (Q, f"Question: {Q}", "copied_question"), (Q, f"{Q}\n{Q}", "copied_question"), (Q, f"{Q} {A}", None),
        (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "Es tut mir leid, dazu darf ich keine Auskunft geben.", "refusal"), (Q, "抱歉，我无法回答这个问题。", "refusal"),
        (Q, 'In the study, 3 of 4 prompts were refused with "I cannot answer".', None), (Q, "Sorry for the confusion earlier. " + A, None), (Q, "I cannot stress enough how small this is. " + A, None),
        (Q, "Der Planer und der Index teilen sich die Tabellen für das Verfahren.", "other_language"), ("Please reply in German. " + Q, "Der Planer und der Index teilen sich die Tabellen.", None), (Q, "该方法需要步才能使奖励函数稳定。", "other_language"),
        (Q, "The planner needs the tables because the cor", "truncated"), (Q, A + " This follows from the", "truncated"), (Q, A + "\n```python\nx = f(3,", "truncated"), (Q, A + " (Peiroth et al.,", "truncated"),
        (Q, "Yes", None), (Q, "On BaesoumQA", None), (Q, "38.5%", None), (Q, "It needs:\n- small tables\n- big tables", None), (Q, A + " Q = 0.7 · r + 0.3 · c", None), (Q, A + "\n```python\nx = f(3)\n```", None),
        (None, A, None), ("", "", "empty"),
    ],
)
def test_p3_labels(prompt, reply, want):
    import pyarrow as pa

    r = P3._examine(pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([prompt], pa.string()), pa.array([reply], pa.string())], ["id", "prompt", "reply"])).to_pylist()[0]
    got = r["defect"] or ("truncated" if r["kind"] in ("broken", "open") else None)
    assert got == want


def test_p3_short_answers_and_open_ends_by_the_model(spark):
    whole = [(i, Q, f"{A} It reaches {i}.5 points on LargeEval. The store keeps the hybrid index.") for i in range(40)]
    short = [(100, Q, "Use BM25"), (101, Q, "Retrieval from a hybrid store"), (102, Q, "With LargeEval"), (103, Q, "Dense passage index")]
    cut = [(200, Q, A + " The store keeps the hyb"), (201, Q, A + " The store keeps the hybrid"), (202, Q, A + " It reaches 14"), (203, Q, "The store keeps the planner and the tables because the planner")]
    refused = [(300, Q, "No answer can be provided for this kind of question."), (301, Q, "Il m'est impossible de traiter cette demande.")]
    got = {tuple(r) for r in P3.pair_defects(spark.createDataFrame(whole + short + cut + refused, "id long, prompt string, reply string")).collect()}
    assert got == {(i, "truncated") for i, *_ in cut} | {(300, "refusal"), (301, "refusal")}


def test_p3_pairs(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(5, "s", "USER ", Q, at(0)), (2, "s", "assistant", None, at(1)), (3, "s", "assistant", "null", at(2)), (9, None, "user", Q, None), (10, None, "assistant", Q, None), (11, "t", "tool", Q, at(0)), (12, "t", None, Q, at(0)), (13, "t", "assistant", "", at(0))]
    df = chat(spark, rows + rows[:2] + [(None, "s", "user", "x", at(0))])
    pairs = P3.reply_pairs(df)
    assert sorted(r["id"] for r in pairs.collect()) == [2, 10]
    assert {tuple(r) for r in P3.pair_defects(pairs).collect()} == {(2, "empty"), (10, "copied_question")}
    assert P3.pair_defects(P3.reply_pairs(df.limit(0))).count() == 0


def test_p3_list_fragments_at_any_count(spark):
    whole = [(i, Q, "It needs:\n- small tables\n- big tables") for i in range(30)]
    for n in (1, 5, 19, 30):
        cut = [(100 + i, Q, "It needs:\n- small tables\n- big tab") for i in range(n)]
        got = P3.pair_defects(spark.createDataFrame(whole + cut, "id long, prompt string, reply string")).collect()
        assert {tuple(r) for r in got} == {(i, "truncated") for i, *_ in cut}, n


def test_p4_matches_brute_force_on_a_hot_session(spark):
    rng = random.Random(2)
    rows, key = [], 0
    for s in ["hot", "odd"] + [f"s{i}" for i in range(30)]:
        n = 3000 if s == "hot" else 601 if s == "odd" else rng.choice([1, 2, 3, 4])
        for i in range(n):
            key += 1
            bad = s.startswith("s") and rng.random() < 0.1
            rows.append((key, s, ("moderator" if bad else ["user", " Assistant "][i % 2]), rng.choice(["text", "text", "text", " "]) if s.startswith("s") else "text", T0 + timedelta(seconds=i // 3)))
    df = chat(spark, rows + rows[:50]).repartition(5)
    want = {}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        by[r[1]].append((r[2].strip().lower(), r[3]))
    for s, m in by.items():
        want[s] = len(m) % 2 == 0 and all(r == ["user", "assistant"][i % 2] and c.strip() for i, (r, c) in enumerate(m))
    assert {r["session_id"]: r["sound"] for r in P4.sessions(df).collect()} == want and want["hot"] and not want["odd"]
    turns = P4.conversations(df).where("session_id = 'hot'").orderBy("turn").collect()
    assert [r["turn"] for r in turns] == list(range(1, 3001)) and [r["id"] for r in turns] == sorted(r[0] for r in rows if r[1] == "hot")
    assert P4.sessions(df.limit(0)).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------


def test_p4_merges_overlapping_exports(spark):
    def part(name, session, places, texts=None):
        return [(name, i, session, p, ["user", "assistant"][p % 2], (texts or {}).get(p, f"m{p}")) for i, p in enumerate(places)]

    rows = part("a", "s", range(0, 5)) + part("b", "s", range(3, 9)) + part("c", "s", range(7, 12)) + part("in", "s", range(4, 7)) + part("twin", "s", range(0, 5))
    rows += part("g1", "gap", range(0, 4)) + part("g2", "gap", range(5, 8))  # the fifth message is missing
    rows += part("f1", "fork", range(0, 3)) + part("f2", "fork", range(2, 4)) + part("f3", "fork", range(2, 4), {3: "other"})  # two go on from one
    rows += part("h1", "half", range(0, 3)) + part("e1", "empty", range(0, 2), {1: " "}) + part("o1", "one", range(0, 2))
    df = spark.createDataFrame(rows + rows[:3] + [(None, 0, "s", 1, "user", "x"), ("n", 0, None, 1, "user", "x")], "fragment string, place int, session_id string, id long, role string, content string").repartition(5)
    got = defaultdict(list)
    for r in P4.merged(df).orderBy("session_id", "turn").collect():
        got[r["session_id"]].append((r["turn"], r["id"]))
    assert got == {"s": [(i + 1, i) for i in range(12)], "one": [(1, 0), (2, 1)]}
    assert P4.merged(df.limit(0)).count() == 0


def mixed(spark):
    """A table of sessions of 6, 40, 22 and 21 messages; three at a time share a time."""
    sizes = {"short": 6, "long": 40, None: 22, "odd": 21}
    return chat(spark, [(i * 100 + j, s, ["user", "assistant"][j % 2], "text", T0 + timedelta(seconds=j // 3)) for i, (s, n) in enumerate(sizes.items()) for j in range(n)])


def test_p4_found_rests_on_the_overlap_graph(spark, monkeypatch):
    df = mixed(spark)
    assert {r["session_id"]: r["sound"] for r in P4.sessions(df).collect()} == {"short": True, "long": True, None: True, "odd": False}
    # Without the edges each export is a path of its own.
    real = P4.overlaps
    monkeypatch.setattr(P4, "overlaps", lambda rows: real(rows).where("whole"))
    assert {r["session_id"]: r["sound"] for r in P4.sessions(df).collect()} == {"short": True, "long": False, None: False, "odd": False}
    assert {r["session_id"] for r in P4.conversations(df).collect()} == {"short"}


def test_p4_judges_exports_in_any_order(spark):
    def sound(exports):
        return {r["session_id"]: r["sound"] for r in P4.judged(P4.assembled(exports)).collect()}

    cuts = P4.fragments(P4.messages(mixed(spark))).withColumn("fragment", F.xxhash64("fragment")).orderBy(F.xxhash64("id", "place"))
    assert sound(cuts) == {"short": True, "long": True, None: True, "odd": False}
    # One export lost leaves a gap.
    gone = cuts.where("session_id = 'long' and id = 120 and place = 0").select("fragment")
    assert gone.count() == 1 and sound(cuts.join(gone, "fragment", "left_anti")) == {"short": True, "long": False, None: True, "odd": False}
    # A ring has no beginning.
    ring = [("r1", 0, "ring", 1, 11, 0), ("r1", 1, "ring", 2, 12, 1), ("r2", 0, "ring", 2, 12, 1), ("r2", 1, "ring", 1, 11, 0)]
    assert sound(spark.createDataFrame(ring, "fragment string, place long, session_id string, id long, h long, kind int")) == {"ring": False}


def test_p5_properties_and_stability(spark):
    rng = random.Random(4)
    for _ in range(60):
        n = rng.choice([0, 1, 1600, 1601, 3000, 9000])
        text = "".join(rng.choice("abcdefgh    .\n") for _ in range(n)) if rng.random() < 0.7 else "x" * n
        cuts = P5.split(text)
        assert all(0 < e - b <= 1600 for b, e in cuts) and (n <= 1600 or all(e - b >= 800 for b, e in cuts))
        assert (not n and not cuts) or (cuts[0][0] == 0 and cuts[-1][1] == n)
        assert all(0 <= e - b2 <= 160 and b2 > b for (b, e), (b2, _) in zip(cuts, cuts[1:]))
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ".", ","]) for _ in range(6000))
    ends = {text[:e][-40:] for _, e in P5.split(text)}
    edited = "An inserted start. " + text
    same = sum(edited[:e][-40:] in ends for _, e in P5.split(edited))
    assert same >= 0.7 * len(ends)  # an edit moves the cuts near it
    df = spark.createDataFrame([("a", "s", text, 1), ("a", "s", text, 2), ("b", "s", "short", 1), ("c", None, None, 1), (None, "s", text, 1)], "chunk_id string, source string, chunk_text string, k int")
    rows = P5.split_oversized(df, "chunk_id", "source", "chunk_text").orderBy("piece").collect()
    assert {r["chunk_id"] for r in rows} == {"a"} and [r["piece"] for r in rows] == list(range(1, len(rows) + 1)) and all(r["text"] == text[r["begin"] : r["end"]] for r in rows)
    assert P5.split_oversized(df.limit(0), "chunk_id", "source", "chunk_text").count() == 0


# --- 6 -----------------------------------------------------------------------------------------------------


def test_p6_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    x[1000:] = x[:500] + 0.1 * rng.standard_normal((500, 64))
    rows = [(f"v{i:04}", v.tolist()) for i, v in enumerate(x)]
    odd = [("zero", [0.0] * 64), ("nan", [math.nan] * 64), ("short", [1.0]), ("none", None), ("empty", []), ("inf", [math.inf] + [1.0] * 63)]
    df = spark.createDataFrame([(k, v, k) for k, v in rows + odd + rows[:5]], "key string, vec array<float>, sim string")
    df = df.where(P6.usable("vec"))
    assert df.count() == 1505
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    want = {(f"v{i:04}", f"v{j:04}") for i in range(1500) for j in np.argsort(-s[i])[:10]}
    got = {(r["key"], r["other"]) for r in P6.nearest(df).collect()}
    assert len(want & got) / len(want) >= 0.95
    near = {(r["key"], r["other"]) for r in P6.nearest(df, least=0.95, probes=2, beam=20).collect()}
    pairs = {(a, b) for a, b in want if s[int(a[1:]), int(b[1:])] >= 0.95}
    assert len(near & pairs) / len(pairs) >= 0.99 and near <= pairs
    assert P6.nearest(df.limit(0)).count() == 0


def test_p6_recall_where_shards_are_many(spark, monkeypatch):
    monkeypatch.setattr(P6, "TARGET", 12)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(3000, 10)) @ rng.normal(size=(10, 64))).astype(np.float32)
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<float>")
    got = defaultdict(set)
    for r in P6.nearest(df, queries=F.substring("key", 2, 9).cast("int") % 10 == 0).collect():
        got[int(r["key"][1:])].add(int(r["other"][1:]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 3000, 10):
        s = x @ x[i]
        s[i] = -2
        hit += len(got[i] & set(np.argsort(-s)[:10].tolist()))
    assert hit >= 0.9 * 3000, hit


def test_p6_tree_bounds_shards_and_descends(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x[1000:2500] = x[0] + 1e-3 * rng.normal(size=(1500, 64))  # a dense cell
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = P6.Tree()
    tree.split(0, P6.kmeans(x, 8))
    for leaf in tree.leaves().tolist():
        tree.split(leaf, P6.kmeans(x[tree.own(x) == leaf], 8))
    assert len(tree.under) > 3 and np.bincount(tree.own(x)).max() < 1000  # Euclidean centroids part the dense cell
    flat = P6.visited(tree, x, 6)
    monkeypatch.setattr(P6, "FLAT", 0)
    deep = P6.visited(tree, x, 6)
    assert (flat[:, 0] == tree.own(x)).all() and (deep[:, 0] == flat[:, 0]).all()
    both = [len(set(a) & set(b)) for a, b in zip(flat.tolist(), deep.tolist(), strict=True)]
    assert np.mean(both) >= 5.4


def test_p6_visitors_in_several_turns_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(600, 6)) @ rng.normal(size=(6, 64))).astype(np.float32)
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<float>")
    monkeypatch.setattr(P6, "TARGET", 60)
    one = {(r["key"], r["other"]) for r in P6.nearest(df, probes=4).collect()}
    monkeypatch.setattr(P6, "VISITORS", 0.3)
    many = {(r["key"], r["other"]) for r in P6.nearest(df, probes=4).collect()}
    assert one == many


def test_p6_copies_fill_lists_with_least_keys(spark):
    df = spark.createDataFrame([(f"k{i:02}", [1.0] + [0.0] * 63) for i in range(30)] + [("z", [1.0, 0.2] + [0.0] * 62)], "key string, vec array<float>")
    got = defaultdict(list)
    for r in P6.nearest(df, least=0.95).orderBy("rank").collect():
        got[r["key"]].append(r["other"])
    assert got["k00"] == [f"k{i:02}" for i in range(1, 11)] and got["k29"] == [f"k{i:02}" for i in range(10)] and got["z"] == [f"k{i:02}" for i in range(10)]


def test_hnsw_small():
    for n in (0, 1, 2, 70):
        x = np.eye(n, 64, dtype=np.float32) if n <= 64 else np.random.default_rng(0).standard_normal((n, 64)).astype(np.float32)
        ids, sims = Hnsw(x).search(x, 3, 8)
        assert ids.shape == (n, min(3, n))
        assert n < 2 or (ids[:, 0] == np.arange(n)).all() or n == 70


# --- 7 -----------------------------------------------------------------------------------------------------


def test_p7_plan_places_all_and_wastes_little(spark):
    rng = random.Random(6)
    hist = Counter(min(4096, max(1, int(rng.lognormvariate(5.4, 0.9)))) for _ in range(20000))
    space, placed = Counter(), Counter()
    for length, lo, hi, first, off, per in P7.plan(hist):
        for r in range(lo, hi):
            space[first + (off + r - lo) // per] += length
        placed[length] += hi - lo
    assert placed == hist and max(space.values()) <= 4096
    assert len(space) <= 1.005 * math.ceil(sum(k * v for k, v in hist.items()) / 4096)
    sizes = spark.createDataFrame([(i, s, 0) for i, s in enumerate([0, None, 1, 10, 10, 25, 9, 3])], "doc_id long, tokens int, container int")
    rows = P7.fill_containers(sizes, "doc_id", "tokens", capacity=10).collect()
    full = Counter()
    for r in rows:
        full[r["container"]] += r["tokens"]
    assert max(full.values()) <= 10 and {r["doc_id"] for r in rows} == set(range(8))
    assert Counter(r["doc_id"] for r in rows) == Counter({5: 3, **{i: 1 for i in range(8) if i != 5}})
    assert P7.fill_containers(sizes.limit(0), "doc_id", "tokens").count() == 0


def test_p7_counts_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a " * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in P7.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 4096


# --- 8 -----------------------------------------------------------------------------------------------------


def test_p8_matches_brute_force(spark):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(200)]
    items = [(i, " ".join(f"item{i}x{j}" if j % 2 else rng.choice(common) for j in range(40)), f"answer{i}") for i in range(12)]
    docs = []
    for d in range(150):
        w = [rng.choice(common) for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            i = rng.randrange(12)
            own = items[i][1].split()
            n = rng.choice([12, 13, 14, 40])
            a = rng.randint(0, 40 - n)
            at = rng.randint(0, len(w))
            w[at:at] = own[a : a + n]
        docs.append((d, " ".join(x.upper() if d % 2 else x for x in w).replace("item", "it­em") if d % 5 == 0 else " ".join(w)))
    grams = defaultdict(set)
    for i, p, _ in items:
        w = p.split()
        for j in range(len(w) - 12):
            grams[tuple(w[j : j + 13])].add(i)
    want = set()
    for d, t in docs:
        w = P8.normal_words(t)
        for j in range(len(w) - 12):
            want |= {(d, i) for i in grams.get(tuple(w[j : j + 13]), ())}
    df = spark.createDataFrame([(d, t, "z") for d, t in docs] + [(None, "x", "z"), (999, None, "z"), (*docs[0], "z")], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items + [(77, None, "a"), (78, "too short", None), (None, "x", "y")], "item_id long, passage string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in P8.leaked_items(df, it).where("kind = 'verbatim'").collect()}
    assert got == want and want
    assert P8.leaked_items(df.limit(0), it).count() == 0 and P8.leaked_items(df, it.limit(0)).count() == 0
    assert P8.lcs(list("abcde"), list("axcye")) == 3


def test_p8_svd_spans_rows(spark):
    rng = np.random.default_rng(1)
    basis = rng.standard_normal((3, 30))
    m = rng.standard_normal((50, 3)) @ basis
    v = P8.randomised_svd(spark, [(list(range(30)), r.tolist()) for r in m], 30, rank=3)
    assert np.allclose(m @ v @ v.T, m, atol=1e-8)


# --- 9 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "sentence, kind",
    [
        ("Title: {{ title }}", "placeholder"), ("Authors: [INSERT NAME HERE]", "placeholder"), ("Keywords: <%= paper.summary %>", "placeholder"), ("It reaches XX.X%.", "placeholder"), ("TODO: fill in", "placeholder"), ("by $KEYWORDS$ and %ABSTRACT%", "placeholder"), ("{0}", "placeholder"),
        ("lorem ipsum dolor sit amet", "filler"), ("asdf asdf asdf test", "filler"), ("Text goes here.", "filler"),
        ("404 Not Found", "error"), ("*** Access denied. ***", "error"), ("Seite nicht gefunden.", "error"), ("Traceback (most recent call last):", "error"), ('File "x.py", line 3, in load', "error"),
        ("Please enable JavaScript to view this paper.", "script"), ("This reader needs scripts.", "script"), ("请启用 JavaScript 以查看本页。", "script"),
        ('The error message "access denied" is part of the environment.', None), ("Prompts were built from a template with the slots {{query}} and {{context}}.", None), ('Annotators marked "[Author Name]" and similar leftovers.', None),
        ("An HTTP 404 reply counts as a failed tool call.", None), ("dependen sobre todo de los pasajes.", None), ("The set {x_1, ..., x_4} is indexed by [i], and f(x) = $0.5$ holds.", None), ("We wrote <answer> and </answer> around every reply.", None), ("Errors stem from human-written plans.", None),
    ],
)
def test_p9_dictionary(sentence, kind):
    found = P9.residue(sentence)
    assert (found[0] if found else None) == kind


def test_p9_spreads_and_edges(spark):
    long = "We are sorry that the archive is temporarily overloaded and that your request for volume {} of the collection could not be served by the reading room at this time of the day by any of the machines we have"
    docs = [(1, long.format(3)), (2, long.format(77).replace("is temporarily overloaded", "seems overloaded now")), (3, "Fine words about plans."), (4, None), (5, ""), (6, "x" * 100000), (7, "404 Not Found")]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs] + [(None, "404 Not Found", "z"), (7, "404 Not Found", "z")], "doc_id long, text string, kind string")
    got = {r["doc_id"] for r in P9.residue_sentences(df).collect()}
    assert {1, 7} <= got and not got & {3, 4, 5, 6}
    assert P9.residue_sentences(df.limit(0)).count() == 0
    a, b = P9.simhashes([["a"] * 700, "a b c d".split()])
    assert a != b and P9.simhashes([[]]).shape == (1,)


def test_p9_learns_unlisted_forms(spark):
    """Placeholder Latin of other words, and the sentences of an error page that no form lists."""
    page = "Access denied.\nOur gnomes are fetching a fresh barrel of bytes.\nKindly come back to the harbour after lunch."
    rows = [(i, f"We study case {i} of the planner.\n{page}" if i < 5 else f"The planner of run {i} reads the table.") for i in range(20)]
    rows += [(50, "Our gnomes are fetching a fresh barrel of bytes."), (51, "Dolera sitam ametu consec adipan elitro sedim eiusmo tempra incido."), (52, "Complement consistent adapters exceed laboratory limits of the planner.")]
    got = {tuple(r) for r in P9.residue_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in got} == {*range(5), 50, 51}
    assert (50, "error") in got and (51, "filler") in got


def test_p9_edited_copies_at_the_similarity_are_all_found(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("bdfgklmnprstv", k=3)) + "a" + str(rng.choice("aeiou")) for _ in range(4000)]

    def shingles(ws):
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    docs, want = [], set()
    for i in range(120):
        n = (15, 25, 40, 60, 100)[i % 5]
        body = rng.choices(vocabulary, k=n)
        residue = ["page", "not", "found", *body]
        # The copy loses what the dictionary knows, or changes a word further on.
        copy = body if i % 2 else body[: n // 2] + ["zzz"] + body[n // 2 + 1 :]
        docs += [(2 * i, " ".join(residue)), (2 * i + 1, " ".join(copy))]
        want.add(2 * i)
        a, b = shingles(residue), shingles(copy)
        if len(a & b) >= 0.8 * len(a | b):
            want.add(2 * i + 1)
    assert sum(d % 2 for d in want) > 50
    got = {r["doc_id"] for r in P9.residue_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want
