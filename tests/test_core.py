"""Core operators against brute force and hand-computed cases."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import losses as L
from textloom.functions import metrics as M
from textloom.functions import text as X
from textloom.operators import align as A
from textloom.operators import chunking as C
from textloom.operators import encode as E
from textloom.operators import mixing as MX
from textloom.operators import store as S
from textloom.operators import tools as TO
from textloom.operators.sequence import with_ordinal, with_previous
from textloom.operators.templates import TEMPLATES, one_turn, turn_pairs
from textloom.options import DataOptions
from textloom.plans import curation as P
from textloom.sources import files as SF
from textloom.streaming import ingest as ST


def test_with_previous_and_ordinal_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 5), i, f"v{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v string").repartition(7)
    got = {r["id"]: (r["has_prev"], r["prev_v"]) for r in with_previous(df, "g", ["t", "id"], ["v"]).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        last = by.get(r[0])
        assert got[r[2]] == ((True, last) if last is not None else (False, None))
        by[r[0]] = r[3]
    places = {r["id"]: r["_ord"] for r in with_ordinal(df, ["t", "id"], "g").collect()}
    seen = Counter()
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        assert places[r[2]] == seen[r[0]]
        seen[r[0]] += 1
    assert with_previous(df.limit(0), "g", ["t", "id"], ["v"]).count() == 0
    assert sorted(r["_ord"] for r in with_ordinal(df, ["id"]).collect()) == list(range(400))


def test_text_functions(spark):
    df = spark.createDataFrame([("2401.01234v2", " a \n b ", "cs.AI stat.ML"), ("hep-th/9901001", None, None), ("0704.0001", "", "math"), ("9912.00001", "RAG x", "")], "id string, title string, categories string")
    r = df.select(X.year_of(F.col("id")).alias("y"), X.clean(F.col("title")).alias("t"), X.category_tokens(F.col("categories")).alias("c")).collect()
    assert [x["y"] for x in r] == [2024, None, 2007, 1999]
    assert r[0]["t"] == "a b" and r[1]["t"] is None and r[0]["c"] == ["csai", "statml"] and r[1]["c"] == []
    one = spark.range(1)
    got = one.select(
        X.remove_thought(F.lit("<think>x\ny</think>\n\nans")).alias("a"), X.fill_slot(F.lit("{{a}} {{a}}"), "a", F.lit("1")).alias("b"), X.timing(F.lit(3725)).alias("c"), X.join_prompt(F.lit("p"), F.lit("")).alias("d"),
    ).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == ("ans", "1 {{a}}", "1:02:05", "p")
    scores = X.keyword_scores(F.array(F.lit("graphrag"), F.lit("retrieval"), F.lit("llm")))
    name, conf = X.best_class(scores)
    assert tuple(one.select(name, conf).first()) == ("rag", pytest.approx(0.5 + 0.1 * (2 + 2)))


def test_curation_and_quota(spark):
    raw = spark.createDataFrame([("2401.1", "t", "abs", "cs.AI"), ("2401.1", "t", "abs", "cs.AI"), ("2301.1", "t", "abs", "cs.AI"), ("2402.1", "t", " ", "cs.AI"), ("2403.1", "t", "abs", "math.AG"), (None, "t", "abs", "cs.AI")], "id string, title string, abstract string, categories string")
    out = spark.createDataFrame([(i, True, None, None, None, {"rag": 0.65}) for i in ("2401.1", "2301.1", "2402.1", "2403.1")] + [("x", None, None, None, None, None)], "id string, is_rag boolean, is_rl boolean, is_agentic_workflow boolean, is_kg boolean, confidence map<string,double>")
    assert [r["id"] for r in P.curate(raw, out).collect()] == ["2401.1"]
    assert {r["id"]: r["accept"] for r in P.decisions(out).collect()}["x"] is False
    assert [r["id"] for r in P.quota(spark.range(9), "id", 5, 2).orderBy("id").collect()] == [0, 1, 2]
    assert P.curate(raw.limit(0), out).count() == 0


def test_chunk_counts_golden(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 200, 201, 380, 381)], "n int")
    assert [r[0] for r in df.select(C.window_count(F.col("n"))).collect()] == [0, 1, 1, 2, 2, 3]
    docs = spark.createDataFrame([(1, [f"w{i}" for i in range(381)]), (2, [])], "id int, w array<string>")
    rows = C.token_windows(docs, F.col("w")).orderBy("chunk_id").collect()
    assert [r["chunk_text"].split()[0] for r in rows] == ["w0", "w180", "w360"] and len(rows[-1]["chunk_text"].split()) == 21


def test_store(spark):
    old = spark.createDataFrame([("a", "1")], "k string, v string")
    new = spark.createDataFrame([("a", "9"), ("b", "2"), ("b", "1"), (None, "x")], "k string, v string")
    assert sorted(map(tuple, S.insert_if_absent(old, new, "k", ["v"]).collect())) == [("a", "1"), ("b", "1")]
    assert S.insert_if_absent(old, new.limit(0), "k", ["v"]).count() == 1
    msgs = spark.createDataFrame([("user", 1), ("tool", 2), ("assistant", 3)], "role string, o int")
    assert sorted((r["o"], r["id"]) for r in S.append_messages(spark.createDataFrame([(7,)], "id long"), msgs, ["o"]).collect()) == [(1, 8), (3, 9)]


def test_mixing_golden(spark):
    df = spark.createDataFrame([("A", "a0"), ("A", "a1"), ("A", "a2"), ("B", "b0")], "s string, k string")
    n = MX.numbered(df, "s", ["k"])
    order = lambda d, c: [r["k"] for r in d.orderBy(c, "source_ord").collect()]
    assert order(MX.interleave_under(n), "rn") == ["a0", "b0"]
    assert order(MX.interleave_over(n), "pos") == ["a0", "b0", "a1", "b0", "a2", "b0"]
    assert order(n, "rn") == ["a0", "b0", "a1", "a2"]
    assert MX.split(spark.range(10), "id", 0.25, 1).where("split = 'validation'").count() == 3
    assert MX.resample(spark.range(10), "id", 25, 1).count() == 25 and MX.resample(spark.range(10), "id", 4, 1).count() == 4


def test_drawn_order_follows_weights(spark):
    df = spark.createDataFrame([(s, f"{s}{i:03}") for s in "AB" for i in range(300)], "s string, k string")
    rows = MX.interleave_drawn(MX.numbered(df, "s", ["k"]), {"A": 3.0, "B": 1.0}, "s", 42).orderBy("pos").collect()
    assert len({r["k"] for r in rows}) == 600
    assert 60 <= sum(r["s"] == "A" for r in rows[:100]) <= 90


def test_drawn_keeps_sources_without_weight(spark):
    df = spark.createDataFrame([(i, ("en", "zh", "off")[i % 3]) for i in range(30)], "id long, source string")
    out = MX.interleave_drawn(MX.numbered(df, "source", ["id"]), {"en": 2.0, "off": 0.0}, "source", 42).collect()
    assert Counter(r["source"] for r in out) == {"en": 10, "zh": 10}


def test_alignment(spark):
    df = spark.createDataFrame([("i", "", "o", [["q", "a"]]), ("i", "x", None, None)], "instruction string, input string, output string, history array<array<string>>")
    a, b = A.align_alpaca(df).collect()
    assert [m["content"] for m in a["_prompt"]] == ["q", "a", "i"] and a["_response"][0]["content"] == "o"
    assert b["_prompt"][0]["content"] == "i\nx" and b["_response"] == []
    conv = "conversations array<struct<from:string,value:string>>"
    df = spark.createDataFrame([([("system", "s"), ("human", "q"), ("gpt", "a")],), ([("human", "q"), ("human", "q")],), ([],), (None,), ([("human", "q")],)], conv)
    r = A.align_sharegpt(df).collect()
    assert (r[0]["_system"], len(r[0]["_prompt"]), len(r[0]["_response"])) == ("s", 1, 1)
    assert all(len(x["_prompt"]) == 0 for x in r[1:])
    df = spark.createDataFrame([([("user", "q"), ("assistant", "c"), ("tool", "1"), ("tool", "2"), ("assistant", "a"), ("tool", "lost")],)], "messages array<struct<role:string,content:string>>")
    r = A.align_openai(df).first()
    assert r["_prompt"][2]["content"] == "1\n</tool_response>\n<tool_response>\n2" and len(r["_prompt"]) == 3
    with pytest.raises(ValueError):
        A.register_converter("alpaca", A.align_alpaca)


def test_encoding_golden(spark):
    for s, t, cut, want in ((100, 10, 50, (40, 10)), (10, 100, 50, (10, 40)), (100, 100, 50, (25, 25))):
        assert tuple(spark.range(1).select(*E.seqlens(F.lit(s), F.lit(t), cut)).first()) == want
    assert [[[5, 3, 4, 2][i] for i in p] for p in E.greedy_knapsack([5, 3, 4, 2], 7)] == [[5, 2], [4, 3]]
    seg = F.array(*[F.lit(x) for x in (1, 1, 2, 2, 2, 0)])
    r = spark.range(1).select(E.segment_lengths(seg).alias("l"), E.unpadded(seg).alias("u"), E.causal_blocks(seg).alias("m")).first()
    assert r["l"] == [2, 3] and r["u"] == [0, 1, 2, 3, 4] and r["m"][3] == [False, False, True, True, False, False] and not any(r["m"][5])
    df = spark.createDataFrame([(i, f"r{i}") for i in range(7)], "_ord long, resp string")
    assert [r[1] for r in df.select("_ord", E.shifted_in_batch("resp", batch_rows=3)).orderBy("_ord").collect()] == ["r2", "r0", "r1", "r5", "r3", "r4", "r6"]
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([4, 4, 9, 1, 20])], "s int, o int, n int")
    got = [r["batch"] for r in E.dynamic_batches(rows, "s", "o", "n", 12).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_kto_and_typed_dialogues(spark):
    df = spark.createDataFrame([([1, 2], [[3], []], [[], [9]]), ([1], [[], [4, 5]], [[7], []])], "p array<int>, r array<array<int>>, k array<array<int>>")
    a, b = E.kto(df, "p", "r", "k", 8).collect()
    assert (a["input_ids"], a["labels"], a["kl_input_ids"], a["kto_tags"]) == ([1, 2, 3], [-100, -100, 3], [1, 2, 9], True)
    assert (b["input_ids"], b["kl_labels"], b["kto_tags"]) == ([1, 4, 5], [-100, 7], False)
    df = spark.createDataFrame([([("human", "q"), ("odd", "x"), ("function_call", "{}"), ("gpt", "a")],), (None,)], "conversations array<struct<from:string,value:string>>")
    r = A.v1_sharegpt(df).collect()
    assert [(m["role"], m["content"][0]["type"], m["loss_weight"]) for m in r[0]["messages"]] == [("user", "text", 0.0), ("assistant", "tool_call", 1.0), ("assistant", "text", 1.0)] and r[1]["messages"] == []


def test_packing_places_every_row(spark):
    rng = random.Random(1)
    rows = [(i, i, [1] * rng.randint(1, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, _ord long, t array<int>")
    got = E.pack_sft(df, "id", F.col("t"), F.col("t"), 32, batch_rows=25).collect()
    assert sorted(int(r["key"]) for r in got) == [i for i, _, t in rows if len(t) <= 32]
    space = Counter()
    for r in got:
        space[r["batch"], r["pack"]] += r["length"]
    assert max(space.values()) <= 32


def test_losses_and_metrics(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    lit = lambda x: F.lit(float(x))
    assert val(L.dpo(lit(1), lit(0), lit(0), lit(0))) == pytest.approx(-math.log(1 / (1 + math.exp(-0.1))))
    assert val(L.dpo(lit(1e6), lit(0), lit(0), lit(0))) == 0 and val(L.dpo(lit(-1e6), lit(0), lit(0), lit(0))) == pytest.approx(1e5)
    assert val(L.perplexity(F.array(lit(0), lit(2)))) == pytest.approx(math.e)
    assert math.isnan(val(L.perplexity(F.array().cast("array<double>"))))
    assert tuple(one.select(*L.sequence_logp(F.array(lit(-1), lit(-2)), F.array(F.lit(-100), F.lit(3)))).first()) == (-2.0, 1)
    assert val(L.eaft(lit(2), F.array(lit(0), lit(0)))) == pytest.approx(2 * math.log(2) / 3)
    assert M.rouge_n("a b c".split(), "a b d".split(), 1) == pytest.approx(200 / 3) and M.rouge_l("a b c".split(), "a x c".split()) == pytest.approx(200 / 3)
    assert M.bleu4(list("abcde"), list("abcde")) == pytest.approx(100) and M.bleu4([], list("a")) == 0
    assert val(M.token_accuracy(F.array(F.lit(5), F.lit(6), F.lit(0)), F.array(F.lit(-100), F.lit(5), F.lit(7)))) == 0.5
    s = val(M.smoothed(F.array(lit(1), lit(2))))
    w = 1.8 * (1 / (1 + math.exp(-0.1)) - 0.5)
    assert s == [1.0, pytest.approx(w + 2 * (1 - w))]


def test_templates_and_tools(spark):
    msgs = F.array(*[A.message(r, F.lit(c)) for r, c in (("user", "q1"), ("assistant", "<think>t</think>\na1"), ("user", "q2"), ("assistant", "a2"))])
    r = spark.range(1).select(*one_turn(TEMPLATES["qwen3"], msgs, F.lit("S"))).first()
    assert r[0].startswith("<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq1") and "<think>" not in r[0] and r[1] == "<think>\n\n</think>\n\na2<|im_end|>\n"
    r = spark.range(1).select(turn_pairs(TEMPLATES["mistral"], msgs, F.lit("S")).alias("p")).first()["p"]
    assert r[0]["prompt"] == "<s>[INST] S\n\nq1[/INST]" and len(r) == 2
    calls = [("f", {"a": 1, "b": "ü"})]
    for name, fmt in TO.FORMATS.items():
        text = fmt.write(calls)
        text = f"<minimax:tool_call>\n{text}\n</minimax:tool_call>" if name == "minimax2" else text
        assert fmt.read(text) == (None if name == "glm4_moe" else calls), name
        assert fmt.read("no call") is None
    assert TO.extract('Action: f\nAction Input: {"a": 1}') == [("f", {"a": 1})] and TO.extract("Action: f\nAction Input: {bad") is None
    df = spark.createDataFrame([(None,), ("x",)], "t string").select(TO.extractor("qwen")("t").alias("c"))
    assert [r["c"] for r in df.collect()] == [None, None]


def test_files_registry_options(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id":"1","title":"t"}\nnot json\n{"id":"2"}\n')
    good, bad = SF.read_jsonl(spark, str(tmp_path / "p.jsonl"))
    good, bad = good.cache(), bad.cache()
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"] and good.where("abstract = ''").count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x")
    assert SF.read_dataset(spark, str(tmp_path / "d")).count() == 1 and SF.read_texts(spark, str(tmp_path / "d")).first()["content"] == "x"
    (tmp_path / "d" / "b.csv").write_text("x")
    with pytest.raises(ValueError):
        SF.read_dataset(spark, str(tmp_path / "d"))
    reg = SF.registry(json.dumps({"a": {"hf_hub_url": "h", "file_name": "f"}, "b": {"file_name": "f", "columns": {"prompt": "q"}}}))
    assert reg["a"].load_from == "hf_hub_url" and reg["b"].columns["prompt"] == "q" and reg["b"].columns["query"] is None
    with pytest.raises(ValueError):
        SF.lookup(reg, ["zzz"])
    out = SF.rename(spark.createDataFrame([("x",)], "q string"), reg["b"]).first()
    assert out["prompt"] == "x" and out["query"] is None and out["_dataset_name"] == "b"
    lines = [r["value"] for r in SF.json_array(spark.range(3), ["id"]).orderBy("_ord").collect()]
    assert json.loads("\n".join(lines)) == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(ValueError):
        DataOptions(dataset=("a",), mask_history=True, train_on_prompt=True)
    assert DataOptions(packing=True).pack_capacity == 2047


def test_streaming_resumes(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("src", "store", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.json").write_text('{"id":"1","v":1}\n{"id":"1","v":1}\n{"id":"2","v":2}\n')
    ST.ingest(spark, src, "id string, v int", store, ck).awaitTermination()
    (tmp_path / "src" / "b.json").write_text('{"id":"2","v":9}\n{"id":"3","v":3}\n')
    ST.ingest(spark, src, "id string, v int", store, ck).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(store).collect())) == [("1", 1), ("2", 2), ("3", 3)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.json").write_text('{"current_steps":1,"total_steps":4,"loss":0}\n{"current_steps":2,"total_steps":4,"loss":1.5}\n')
    ST.monitor(spark, str(tmp_path / "log"), "logs", once=True).awaitTermination()
    log = spark.table("logs")
    assert ST.latest(log).first()["percentage"] == 50.0 and [tuple(r) for r in ST.losses(log).collect()] == [(2, 1.5)]


def test_queries_have_unique_names_and_plans(spark):
    import __spark_entry__ as entry
    from textloom import catalog

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
