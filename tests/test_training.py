"""Encoding, packing, collation, templates, rendering, the engine, services and files on small fixtures."""

import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom import services as SV
from textloom.functions import compute as CO
from textloom.functions import losses as L
from textloom.functions import metrics as M
from textloom.functions import text as X
from textloom.operators import align as A
from textloom.operators import encode as E
from textloom.operators import engine as G
from textloom.operators import mixing as MX
from textloom.operators import render as R
from textloom.operators import templates as TP
from textloom.operators import tools as TL
from textloom.operators.sequence import with_ordinal
from textloom.operators.vector import nearest_in_blocks
from textloom.plans import curation as P
from textloom.plugins import Registry
from textloom.sources import records as RC
from textloom.streaming.ingest import RowStream


def cut(s, t, room):
    """The rule of lengths in plain Python."""
    most = room if t * 2 < room else room - s if s * 2 < room else int(room * (t / (s + t))) if s + t else room
    new = min(most, t)
    return max(min(max(room - new, 0), s), 0), new


def brute_turns(pairs, cutoff, prompt, last_only, eos):
    ids, labels, total = [], [], 1 if eos is not None else 0
    for n, (p, r) in enumerate(pairs[::-1] if last_only else pairs):
        if total >= cutoff:
            break
        a, b = cut(len(p), len(r), cutoff - total)
        p, r = p[:a], r[:b]
        total += a + b
        before = p if prompt else [eos] + [-100] * (a - 1) if eos is not None and n else [-100] * a
        after = [-100] * b if last_only and n else r
        ids, labels = (p + r + ids, before + after + labels) if last_only else (ids + p + r, labels + before + after)
    return (ids + [eos], labels + [eos]) if eos is not None else (ids, labels)


@pytest.mark.parametrize("prompt, last_only, eos", [(False, False, None), (True, False, None), (False, True, None), (False, False, 9)])
def test_multi_turn_matches_brute_force_where_it_is_cut(spark, prompt, last_only, eos):
    rng = random.Random(1)
    rows = [(i, [([rng.randrange(10, 99) for _ in range(rng.randint(1, 9))], [rng.randrange(10, 99) for _ in range(rng.randint(1, 9))]) for _ in range(rng.randint(1, 4))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, pairs array<struct<prompt:array<int>,response:array<int>>>")
    ids, labels = E.multi_turn(F.col("pairs"), 20, train_on_prompt=prompt, mask_history=last_only, eos=eos)
    for r in df.select("id", ids.alias("ids"), labels.alias("labels")).collect():
        want = brute_turns([(list(p), list(q)) for p, q in rows[r["id"]][1]], 20, prompt, last_only, eos)
        assert (r["ids"], r["labels"]) == want


def test_packed_rows_and_parameters(spark):
    rows = [(i, [i] * n, [i] * n, m) for i, (n, m) in enumerate([(5, 1), (3, 0), (4, 2), (2, 0), (9, 0), (0, 0)])]
    df = spark.createDataFrame(rows, "_ord int, ids array<int>, labels array<int>, n_images int")
    got = E.packed_sft(df, "_ord", F.col("ids"), F.col("labels"), 7, pad_id=77, media={"image": "n_images"}).orderBy("pack").collect()
    assert sorted(k for r in got for k in r["keys"]) == ["0", "1", "2", "3", "5"]  # nine tokens are too many
    first = got[0]
    assert first["input_ids"] == [0] * 5 + [3] * 2 + [77] and first["position_ids"] == [0, 1, 2, 3, 4, 0, 1, 0] and first["attention_mask"] == [1] * 5 + [2] * 2 + [0]
    assert first["packing_params"]["sequence_boundaries"][:3] == [0, 5, 7] and first["packing_params"]["sequence_boundaries"][-1] == 8
    assert first["packing_params"]["image_subseq_ids"] == [0] and first["packing_params"]["video_subseq_ids"] == [1 << 32]
    plain = E.packed_sft(df, "_ord", F.col("ids"), F.col("labels"), 7, neat=False).first()
    assert plain["attention_mask"] == [1] * 8
    assert E.packed_sft(df.limit(0), "_ord", F.col("ids"), F.col("labels"), 7).count() == 0
    assert E.greedy_knapsack([5, 3, 4, 2], 7) == [[0, 3], [2, 1]] and E.greedy_knapsack([2, 2, 2], 4) == [[2, 1], [0]] and E.greedy_knapsack([], 3) == []
    with pytest.raises(ValueError):
        E.greedy_knapsack([9], 7)


def test_pretrain_blocks_cut_rows_across_blocks(spark):
    rows = [(0, [1, 2, 3]), (1, []), (2, list(range(4, 14))), (3, [14])]
    df = spark.createDataFrame(rows, "_ord int, t array<int>")
    got = {r["block"]: r["input_ids"] for r in E.pretrain_blocks(df, F.col("t"), 4).collect()}
    assert got == {0: [1, 2, 3, 4], 1: [5, 6, 7, 8], 2: [9, 10, 11, 12]}
    two = {(r["batch"], r["block"]): r["input_ids"] for r in E.pretrain_blocks(df, F.col("t"), 4, batch_rows=2).collect()}
    assert two == {(1, 0): [4, 5, 6, 7], (1, 1): [8, 9, 10, 11]}


def test_stages_and_buffers(spark):
    df = spark.createDataFrame([("q one", "a"), ("q two", None), ("", "b")], "instruction string, output string").withColumn("id", F.monotonically_increasing_id())
    rows = with_ordinal(A.align_alpaca(df, ["id"]), ["id"])
    assert E.encode(rows, "sft", 64, keep=["id"]).count() == 2 and E.encode(rows, "generate", 64, keep=["id"]).count() == 3 and E.encode(rows, "rm", 64, keep=["id"]).count() == 0
    assert E.encode(rows, "pt", 4, keep=["id"]).count() == 3 and E.encode(rows, "sft", 64, keep=["id"], packing=True).count() == 1
    with pytest.raises(ValueError):
        E.encode(rows, "nothing", 64)
    b = E.TokenBuffer(5)
    assert b.put([1] * 9) and not b.put([1]) and E.TokenBuffer.restored(b.state()).tokens == 9 and b.get(1) == [[1] * 9] and b.tokens == 0
    assert E.micro_batches_of(64, 4, 2) == 8 and E.batches_of(10, 2, 2) == 3
    with pytest.raises(ValueError):
        E.micro_batches_of(10, 4, 2)
    one = spark.range(1)
    assert one.select(E.nested(F.array(*map(F.lit, range(5))), F.array(F.lit(2), F.lit(0), F.lit(3)))).first()[0] == [[0, 1], [], [2, 3, 4]]
    assert one.select(E.prefix_types(F.lit(2), F.lit(5), 2)).first()[0] == [0, 0, 0, 0, 1]
    assert one.select(E.token_types(F.array(F.lit(7), F.lit(3)), 7)).first()[0] == [1, 0]
    assert one.select(E.additive(E.causal_blocks(F.array(F.lit(1), F.lit(2))))).first()[0][1][1] == 0.0
    assert one.select(E.pair_survives(F.array(F.lit(-100), F.lit(5)), F.array(F.lit(1), F.lit(2)))).first()[0] is False


def test_all_templates_render_and_know_their_formats(spark):
    msgs = F.array(A.message("user", F.lit("q")), A.message("assistant", F.lit("a")))
    assert len(TP.TEMPLATES) >= 123
    got = spark.range(1).select(*[F.concat_ws("|", *TP.one_turn(t, msgs, F.lit("S"))).alias(n.replace(".", "_").replace("-", "_")) for n, t in TP.TEMPLATES.items()]).first().asDict()
    for n, t in TP.TEMPLATES.items():
        text = got[n.replace(".", "_").replace("-", "_")]
        assert "q" in text and text.rstrip().count("a") >= 1 and (not t.tool_format or t.tool_format in TL.FORMATS), n
        assert "{{" not in text, n
    assert TP.special_tokens(TP.TEMPLATES["chatml"], "</s>") == {"eos": "<|im_end|>", "pad": "<|im_end|>", "stop_words": ["<|im_start|>"]}
    assert TP.stop_tokens(TP.TEMPLATES["qwen"]) == ["</s>", "<|im_end|>"] and TP.resolve(None).name == "empty" and TP.resolve("qwen", "glm4", "X").default_system == "X"
    with pytest.raises(ValueError):
        TP.resolve("no such template")


def test_thoughts_of_reasoning_templates(spark):
    t = TP.TEMPLATES["qwen3"]
    msgs = F.array(*[A.message(r, F.lit(c)) for r, c in (("user", "q1"), ("assistant", "<think>x</think>\na1"), ("user", "q2"), ("assistant", "<think>y</think>a2"))])
    one = lambda **kw: spark.range(1).select(*TP.one_turn(t, msgs, **kw)).first()
    assert "<think>x" not in one()[0] and one()[1].startswith("<think>y") and "<think>x" in one(preserve=True)[0]
    assert one(think=False)[0].endswith("<think>\n\n</think>\n\n") and one(think=False)[1] == "a2<|im_end|>\n"
    pairs = lambda **kw: spark.range(1).select(TP.turn_pairs(t, msgs, **kw)).first()[0]
    assert pairs()[0]["response"].startswith("<think>x") and pairs(discard_history=True)[0]["response"] == "a1<|im_end|>\n"
    assert pairs(think=False)[0]["prompt"].endswith("<think>\n\n</think>\n\n") and pairs(think=False)[1]["response"] == "a2<|im_end|>\n"


def test_calls_and_tools_in_templates(spark):
    t = TP.TEMPLATES["qwen"]
    msgs = F.array(A.message("user", F.lit("q")), A.message("function", F.lit('{"name": "f", "arguments": {"a": 1}}')))
    bad = F.array(A.message("user", F.lit("q")), A.message("function", F.lit("no json")))
    df = spark.range(1).select(TP.with_calls(msgs, t).alias("m"), TP.with_calls(bad, t).alias("b"), TP.tools_of(t, F.lit('[{"name": "f"}]')).alias("t"), TP.tools_of(t, F.lit("{bad")).alias("x"), TP.tools_of(TP.TEMPLATES["phi4_mini"], F.lit("[]")).alias("p"))
    r = df.first()
    assert "<tool_call>" in r["m"][1]["content"] and r["b"][1]["content"] is None and "<tools>" in r["t"] and r["x"] is None and r["p"] == "<|tool|>[]<|/tool|>"
    text = df.select(F.array_join(TP.render(t, F.col("m"), tools=F.col("t")), "")).first()[0]
    assert text.index("<tools>") < text.index("<|im_start|>user")
    assert TL.function_text('<think>x</think>{"name": "f", "arguments": {}}', "glm4", ("<think>", "</think>")) == "<think>x</think>f\n{}"
    with pytest.raises(ValueError):
        TL.tool_format("glm4").write([("a", {}), ("b", {})])
    assert TL.extract("Action: f Action Input: {\"a\": 1}") == [("f", {"a": 1})] and TL.extract('<invoke name="f"></invoke>', "minimax2") is None
    assert TL.extract("<tool_call>{\"name\": \"f\", \"arguments\": {}}</tool_call> and more", "qwen") is None
    assert TL.tools_text("[]", "qwen") == "" and "- q (string, required): what, should be one of [a, b]" in TL.tools_text(json.dumps([{"name": "s", "parameters": {"properties": {"q": {"type": "string", "description": "what", "enum": ["a", "b"]}}, "required": ["q"]}}]))


def test_templates_for_other_systems():
    t = TP.TEMPLATES["qwen"]
    assert "<|im_start|>user" in TP.jinja(t) and "{{ .System }}" in TP.ollama(t) and "loop.index0 == 0" in TP.jinja(TP.TEMPLATES["llama2"])

    def apply(messages, generate):
        out = "<s>" if messages[0]["role"] == "system" else "<s>[sys]Be kind.[/sys]\n"
        for m in messages:
            out += f"[sys]{m['content']}[/sys]\n" if m["role"] == "system" else f"[{m['role']}]{m['content']}\n" if m["role"] == "user" else f"{m['content']}</s>\n"
            out += "[answer]" if m["role"] == "user" and (m is not messages[-1] or generate) else ""
        return out

    p = TP.parse_template(apply)
    assert p.user == "[user]{{content}}\n[answer]" and p.assistant == "{{content}}<eos>\n" and p.default_system == "Be kind." and p.system == "<s>[sys]{{content}}[/sys]\n"


def test_render_and_parse_edges(spark):
    plain = lambda role, *parts: {"role": role, "content": [{"type": k, "value": v} for k, v in parts], "loss_weight": None}
    assert R.qwen3([]) == [] and R.parse("") == [] and R.parse("a") == [{"type": "text", "value": "a"}]
    with pytest.raises(ValueError):
        R.parse("<tool_call>bad</tool_call>")
    tools = R.qwen3([plain("user", ("text", "q"))], tools='{"name": "f"}', generate=True)
    assert tools[0][0].startswith("<|im_start|>system\n# Tools") and tools[-1][0].endswith("</think>\n\n")
    assert R.last_query([plain("user", ("text", "q")), plain("user", ("text", "<tool_response>x</tool_response>"))]) == 0
    assert R.split_content(plain("assistant", ("text", "a"), ("reasoning", "b")))[:2] == ("a", "b")
    df = spark.createDataFrame([(None,), ("<think>\nw\n</think>\nx",)], "t string").select(R.parser("qwen3")("t").alias("c"))
    assert [len(r["c"]) if r["c"] else None for r in df.collect()] == [None, 2]
    with pytest.raises(ValueError):
        R.renderer("nothing")


def test_engine(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "k int, g int")
    index = G.index({"a": df.where("g = 0"), "b": df.where("g = 1")}, "k")
    assert index.count() == 20 and G.size_of(index) == 20 and G.size_of(index, True) == -1
    pick = lambda w: [(r["dataset"], r["row"]) for r in G.select(index, w, ["dataset", "row"]).orderBy("place").collect()]
    assert pick(-1) == [("b", 9)] and pick(slice(-2, None)) == [("b", 8), ("b", 9)] and len(pick([0, 0, 3])) == 3
    with pytest.raises(IndexError):
        pick(20)
    own = index.where("dataset = 'a'")
    assert G.resized(own, 10, 25, 1.0, 1).count() == 25 and G.resized(own, 10, None, 0.5, 1).count() == 5 and G.resized(own, 10, 8, 2.0, 1).count() == 16
    assert G.resized(own, 10, 25, 1.0, 1).select("row").distinct().count() <= 10
    shots = G.few_shot(df.where("k < 6"), df.where("k >= 6").withColumnRenamed("k", "t"), "k", "g", 3, 1)
    assert shots.groupBy("k").count().where("count = 3").count() == 6
    assert G.epoch_order(df, "k", 1, 0, 4).count() == 28 and G.split_module({"train": 1, "validation_x": 2}) == {"train_dataset": 1, "eval_dataset": {"x": 2}}
    assert G.merged({}) is None and G.merged({"a": df, "b": df}).count() == 60
    (tmp_path / "d.jsonl").write_text('{"instruction":"q","output":"a"}\n')
    es = G.entries(json.dumps({"x": {"path": str(tmp_path / "d.jsonl"), "converter": "alpaca"}}))
    assert G.load(spark, es["x"]).first()["_dataset_name"] == "x" and G.entries("some/path")["default"].path == "some/path"
    with pytest.raises(ValueError):
        G.entries(json.dumps({"a": {"path": "x", "streaming": True}, "b": {"path": "y"}}))
    stream = RowStream(df, ["k"], block=7)
    it = iter(stream)
    assert [next(it)["k"] for _ in range(10)] == list(range(10))
    assert [r["k"] for r in RowStream(df, ["k"], block=7, state=stream.state())] == list(range(10, 30))
    r = Registry("thing")
    r.register("a")(len)
    with pytest.raises(ValueError):
        r.register("a")(len)
    with pytest.raises(ValueError):
        r.get("b")


def test_repeats_of_a_short_source(spark, monkeypatch):
    monkeypatch.setattr(MX, "ROUNDS", 5)
    rows = MX.numbered(spark.createDataFrame([(i, "long") for i in range(23)] + [(100, "short")], "k int, s string"), "s", ["k"])
    got = sorted((r["pos"], r["k"]) for r in MX.interleave_over(rows).collect() if r["s"] == "short")
    assert got == [(i, 100) for i in range(23)]


def test_numbers_of_text_and_sizes(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(CO.pixels(F.lit("768 * 768"))) == 589824 and val(CO.pixels(F.lit("x"))) is None
    assert val(F.array(*CO.video_size(F.lit(1), F.lit(1000), 10**9, 0))) == [28, 1000] and val(F.array(*CO.video_size(F.lit(28), F.lit(28 * 300), 10**9, 0))) == [28, 28 * 180]
    assert val(CO.video_frames(F.lit(0), F.lit(0.0), 2.0, 4)) == [0, 1, 2, 3] and val(CO.video_frames(F.lit(9), F.lit(2.0), 2.0, 8)) == [0, 2, 5, 8]
    with pytest.raises(ValueError):
        CO.mfu(F.lit(1.0), F.lit(1.0), "abacus")
    assert val(CO.unsupported({"images": F.array(F.lit("a"))}, set())) == "images" and val(CO.unsupported({"images": F.array(F.lit("a"))}, {"images"})) is None
    assert val(CO.media_paths(F.array(F.lit("a"), F.lit("b")), "/m", F.array(F.lit("/m/a")))) == ["/m/a", "b"]
    for url, fine in (("https://example.org/x", True), ("http://192.168.1.1/", False), ("ftp://a.b/", False), ("http://[::1]/", False), ("http://user@10.1.1.1/", False), (None, False), ("http://172.20.0.1", False)):
        assert val(X.public_url(F.lit(url).cast("string"))) is fine, url
    assert val(X.inside_folder(F.lit("/m/../etc"), "/m")) is False and val(X.inside_folder(F.lit("/m/a"), "/m/")) is True
    assert X.longest_difference("ac", "abc") == "b" and X.split_fields("a int, b struct<x:int,y:int>") == ["a int", "b struct<x:int,y:int>"]
    assert "packing False" in X.command("train", {"packing": False, "x": None, "y": ""}) and X.generation({"max_tokens": 3})["top_p"] == 0.9
    assert val(X.has_slot(F.lit("a {{b}}"))) and len(val(X.key_uuid(F.lit("k")))) == 36 and M.segments("知识 graph") == ["知", "识", "graph"]
    assert val(L.kl_divergence(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0)))) == pytest.approx(0)


def test_percentile_and_search(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, rng.uniform(-50, 50), float(rng.randint(-3, 3))])) for g in "ab" for _ in range(301)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["p"] for r in M.percentile(df, ["g"], F.col("v"), share, "p").collect()}
        want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", share).alias("p")).collect()}
        assert got == pytest.approx(want)
    vecs = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "k int, v array<double>")
    got = nearest_in_blocks(vecs, vecs.where("k < 3").select(F.col("k").alias("query"), F.col("v").alias("q")), "k", 4, 2, block=2).collect()
    assert sorted((r["query"], r["k"]) for r in got) == sorted((q, q + 7 * i) for q in range(3) for i in range(4))
    assert nearest_in_blocks(vecs, vecs.limit(0).select(F.col("k").alias("query"), F.col("v").alias("q")), "k", 4, 2).count() == 0
    every = vecs.select(F.col("k").alias("query"), F.col("v").alias("q"))
    assert {tuple(r) for r in nearest_in_blocks(vecs, every, "k", 4, 2, most_queries=7).collect()} == {tuple(r) for r in nearest_in_blocks(vecs, every, "k", 4, 2).collect()}


def test_search_holds_little_and_sends_k_rows(spark, monkeypatch):
    """The mapper of an exact search: its memory does not follow queries by rows, nor what it sends the ties."""
    ran = []
    vecs = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(3000)], "k int, v array<double>")
    monkeypatch.setattr(type(vecs), "mapInArrow", lambda df, run, schema: ran.append(run) or spark.createDataFrame([], schema))

    def mapped(x, sizes):
        assert nearest_in_blocks(vecs, vecs.select(F.col("k").alias("query"), F.col("v").alias("q")), "k", 5, 4).count() == 0
        ends = np.cumsum([0, *sizes])
        batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int32()), pa.array(list(x[a:b]))], ["k", "v"]) for a, b in zip(ends, ends[1:])]
        tracemalloc.start()
        out = [b for b in ran[-1](iter(batches)) if b.num_rows]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return pa.Table.from_batches(out).to_pandas(), most

    q = np.array([np.random.default_rng(i).normal(size=4) for i in range(3000)])
    x = np.random.default_rng(9).normal(size=(5001, 4))
    got, most = mapped(x, [5000, 0, 1])
    assert most < 60e6  # the distances of all pairs are 120 MB
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    far = np.round(1 - unit(q) @ unit(x).T, 6) + 0.0
    want = np.argsort(far, axis=1, kind="stable")[:, :5]
    assert len(got) == 15000 and got.sort_values(["query", "distance", "k"])["k"].tolist() == want.ravel().tolist()
    got, _ = mapped(np.ones((600, 4)), [300, 300])
    assert sorted(zip(got["query"], got["k"])) == [(i, j) for i in range(3000) for j in range(5)]
    ran.clear()
    monkeypatch.setattr("textloom.operators.vector._TILE", 64)
    few = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query int, q array<double>")
    assert nearest_in_blocks(vecs, few, "k", 5, 4, block=1).count() == 0
    parts = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 3), pa.int32()), pa.array(list(x[a : a + 3]))], ["k", "v"]) for a in range(0, 900, 3)]
    near = np.round(1 - unit(x[:900])[:, 0], 6) + 0.0  # keys that are no longer asked for are dropped many times here
    assert pa.Table.from_batches(ran[-1](iter(parts)))["k"].to_pylist() == np.argsort(near, kind="stable")[:5].tolist()


def test_services_mark_what_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "c")], "id int, prompt string")

    def model(prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    got = {r["id"]: (r["predict"], r["error"]) for r in SV.infer(df, model, batch=4, retries=0).collect()}
    assert got[1] == ("A", None) and got[2] == (None, None) and got[3][0] is None and "no" in got[3][1] and got[4] == ("C", None)
    e = SV.embed(df, lambda xs: [[1.0, 2.0] if x == "a" else [1.0] for x in xs], 2, "prompt").collect()
    assert [r["embedding"] for r in e if r["id"] == 1] == [[1.0, 2.0]] and [r["error"] for r in e if r["id"] == 4] == ["length 1"]
    usage = {}
    assert "".join(SV.streamed([("a", None), ("", None), ("b", {"total_tokens": 2})], usage)) == "ab" and usage == {"total_tokens": 2}
    hits = spark.createDataFrame([("q", "x", 1), ("q", "yy", 2), ("q", "zz", 3)], "q string, t string, k int")
    assert [r["k"] for r in SV.rerank(hits, lambda ps: [float(len(b)) for _, b in ps], "q", "t", 2, "k").orderBy("rank").collect()] == [2, 3]
    urls = spark.createDataFrame([("http://10.0.0.1/",), ("https://example.org/",)], "url string")
    got = {r["url"]: (r["content"], r["error"]) for r in SV.download(urls, lambda u: b"x").collect()}
    assert got == {"http://10.0.0.1/": (None, "url refused"), "https://example.org/": (b"x", None)}
    out = P.classify(spark.createDataFrame([("1", "good"), ("2", "odd")], "id string, abstract string"), lambda ps: ['{"is_rag": true}' if "good" in p else "nope" for p in ps], "is_rag boolean")
    assert {(r["id"], r["is_rag"], r["error_message"] is None) for r in out.collect()} == {("1", True, True), ("2", None, False)}


def test_files_of_results(spark, tmp_path):
    root = str(tmp_path)
    RC.write_text_per_key(spark.createDataFrame([("a/b", "x"), ("c", None), (None, "z")], "k string, t string"), "k", "t", f"{root}/texts")
    assert sorted(p.name for p in (tmp_path / "texts").glob("*.txt")) == ["a_b.txt", "c.txt"]
    assert RC.load_tokenized(spark, f"{root}/none") is None
    RC.save_tokenized({"train": spark.range(3)}, f"{root}/tok")
    assert RC.load_tokenized(spark, f"{root}/tok")["train"].count() == 3
    with pytest.raises(ValueError):
        RC.save_tokenized({}, root, streaming=True)
    for step, done in ((5, True), (10, True), (20, True), (15, False), (30, False)):
        (tmp_path / "ck" / f"checkpoint-{step}").mkdir(parents=True)
        if done:
            (tmp_path / "ck" / f"checkpoint-{step}" / "COMPLETE").write_text("")
    assert RC.latest_checkpoint(spark, f"{root}/ck").endswith("checkpoint-20")
    assert sorted(p.rsplit("-", 1)[1] for p in RC.rotate_checkpoints(spark, f"{root}/ck", 2)) == ["15", "5"]
    log = []
    clock = iter([0.0, 0.5, 1.0, 3.0, 9.0])
    assert RC.logs_node("n", log.append, lambda: next(clock))(lambda: 7)() == 7 and log[0]["latency"] == 500.0
    RC.logs_model("m", log.append, lambda: next(clock))(lambda p: ("out", {"completion_tokens": 4}))("in")
    assert log[1]["token_generation"] == 2.0 and log[1]["model_latency"] == 2.0
    with pytest.raises(RuntimeError):
        RC.logs_node("n", log.append, lambda: 0.0)(lambda: (_ for _ in ()).throw(RuntimeError()))()
    assert len(log) == 2
    assert RC.read_config(f"{root}/missing") == {}
    (tmp_path / "c.yaml").write_text("a:\n  b: 1\n  c: x\n")
    assert RC.read_config(f"{root}/c.yaml") == {"a": {"b": 1, "c": "x"}}
    with pytest.raises(ValueError):
        RC.read_cloud_json(spark, "/local/x.json")
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "a.jsonl").write_text('{"x":1}\n\n{"x":2}\n')
    (tmp_path / "bucket" / "b.json").write_text('[{"x":3}]')
    (tmp_path / "bucket" / "c.txt").write_text("no")
    assert sorted(r["x"] for r in RC.read_cloud_json(spark, f"{root}/bucket", (root,)).collect()) == [1, 2, 3]
    assert RC.zipped({"a": spark.range(3).withColumn("x", F.col("id") * 2), "b": spark.range(2).withColumn("y", F.col("id") + 1)}, {"a": "id", "b": "id"}).count() == 2
    assert json.loads(RC.average_scores(spark.createDataFrame([(1.0, 2.0)], "b double, a double"), ["b", "a"])) == {"a": 2.0, "b": 1.0}
    assert RC.subjects('{"x": {"name": "X", "category": "c"}}', "mmlu_test") == ([("x", "X", "c")], "test")


def test_tokenizer_windows(spark):
    import os

    from textloom.functions.tokenizer import decoder, encoder, token_chunks

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    df = spark.createDataFrame([(1, "The planner reads the table. " * 90), (2, ""), (3, None), (4, "Zürich 知识")], "id int, text string")
    assert {r["id"]: r["t"] for r in df.select("id", decoder(path)(encoder(path)("text")).alias("t")).collect()}[4] == "Zürich 知识"
    got = token_chunks(df, "text", path).orderBy("id", "chunk_id").collect()
    assert [r["chunk_id"] for r in got if r["id"] == 1] == list(range(len([r for r in got if r["id"] == 1]))) and {r["id"] for r in got} == {1, 4}


def test_arrow_files_and_batching_plugins(spark, tmp_path):
    import pyarrow as pa

    from textloom.plugins import BATCHING
    from textloom.sources.files import read_dataset

    table = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    for name, new in (("one.arrow", pa.ipc.new_file), ("two.arrow", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, new(f, table.schema) as w:
            w.write_table(table)
    assert sorted((r["a"], r["b"] or "") for r in read_dataset(spark, str(tmp_path)).collect()) == sorted([(1, "x"), (2, ""), (3, "z")] * 2)
    assert BATCHING.get("normal", "rows")(4, 2) == 8 and BATCHING.get("padding_free", "count")(17, 4, 2) == 2 and BATCHING.get("dynamic_batching", "count")(17, 4, 2) == 3
    rows = spark.createDataFrame([(1, [5, 6], [-100, 6])], "id int, input_ids array<int>, labels array<int>")
    assert "labels: <6>" in E.example(rows, ["id"], lambda ids: "<" + " ".join(map(str, ids)) + ">") and E.example(rows.limit(0), ["id"], str) == ""
