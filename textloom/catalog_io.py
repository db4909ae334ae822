"""Queries that write files to the shared folder and read them back, and streams over such files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.catalog import _CHAT, _PAIRS, _chat, _pairs, query
from textloom.catalog_formats import _DIALOGUES, _SOUND, dialogues
from textloom.common import read, shared_dir
from textloom.functions import metrics as M
from textloom.functions import text as X
from textloom.operators import align as A
from textloom.operators import encode as E
from textloom.operators import engine as G
from textloom.plans import curation as P
from textloom.sources import files as SF
from textloom.sources import records as RC
from textloom.streaming import ingest as ST


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PAPERS = "select id, title, abstract, categories from raw_papers"
_FILLED = "coalesce(id, '') as id, coalesce(title, '') as title, coalesce(abstract, '') as abstract, coalesce(categories, '') as categories"


@query(f"select {_FILLED} from raw_papers union all select {_FILLED} from raw_papers")
def jsonl_append_and_scan(spark, sf_dir):
    """Two appends of one table, then a scan; missing texts are empty."""
    path, rows = _folder(spark, "papers"), read(spark, sf_dir, "raw_papers").select("id", "title", "abstract", "categories")
    SF.write_jsonl(rows, path)
    SF.write_jsonl(rows, path)
    return SF.read_jsonl(spark, path)[0]


@query("select cast(doc_id as varchar) || '.txt' as name, text as content from documents where text is not null and text <> ''")
def text_files(spark, sf_dir):
    """Each document as a file of its own, read back as a folder of texts."""
    path = _folder(spark, "texts")
    RC.write_text_per_key(read(spark, sf_dir, "documents").where("text is not null and text <> ''"), "doc_id", "text", path)
    return SF.read_texts(spark, path).select(F.substring_index("source", "/", -1).alias("name"), "content")


@query("select distinct trim(id) as id from raw_papers where trim(id) <> ''")
def checkpoint_ids(spark, sf_dir):
    path, ids = _folder(spark, "ids"), read(spark, sf_dir, "raw_papers").select("id")
    RC.append_ids(ids, "id", path)
    RC.append_ids(ids.limit(5), "id", path)  # an id that is appended again counts once
    return SF.read_ids(spark, path)


@query("""select source, cast(doc_id as integer) as chunk_id, text as chunk_text from documents where text is not null""")
def chunk_files(spark, sf_dir):
    path = _folder(spark, "chunks")
    RC.write_chunks(read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("chunk_text")), path)
    return spark.read.schema("source string, chunk_id int, chunk_text string").json(path)


@query(f"""with {_PAIRS} select id, case when id % 10 = 0 then 'validation' else 'train' end as split, cast(len(list_filter(regexp_split_to_array(coalesce(prompt, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) as integer) as tokens from pairs""")
def tokenized_files(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", E.token_ids(F.col("prompt")).alias("input_ids"))
    path = _folder(spark, "tokenized")
    RC.save_tokenized({"train": rows.where("id % 10 <> 0"), "validation": rows.where("id % 10 = 0")}, path)
    held = RC.load_tokenized(spark, path)
    return held["train"].withColumn("split", F.lit("train")).unionByName(held["validation"].withColumn("split", F.lit("validation"))).select("id", "split", F.size("input_ids").alias("tokens"))


@query(f"with {_PAIRS} select coalesce(prompt, '') as prompt, coalesce(reply, '') as predict, coalesce(reply, '') as label from pairs")
def prediction_files(spark, sf_dir):
    path = _folder(spark, "predictions")
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = _pairs(spark, sf_dir).select(text("prompt").alias("p"), text("reply").alias("r"))
    SF.write_jsonl(RC.predictions(rows, "p", "r", "r"), path)
    return spark.read.schema("prompt string, predict string, label string").json(path)


@query("select vec_id, round(embedding[1]::double, 2) + 0.0 as chosen, round(embedding[2]::double, 2) + 0.0 as rejected from embeddings")
def reward_files(spark, sf_dir):
    path = _folder(spark, "rewards")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("c"), F.col("embedding")[1].cast("double").alias("r"))
    both = RC.reward_rows(rows.select("c", "r"), "c", "r")
    SF.write_jsonl(rows.select("vec_id", *[(F.round(x, 2) + 0.0).alias(n) for x, n in zip(("c", "r"), both.columns, strict=True)]), path)
    return spark.read.schema("vec_id long, chosen double, rejected double").json(path)


@query("""with o as (select doc_id, source, row_number() over (order by doc_id) - 1 as _ord, count(*) over () as n from documents)
    select _ord, case when _ord = 0 then '[' || chr(10) else '' end || '  {"doc_id":' || doc_id || ',"source":' || to_json(source) || '}' || case when _ord = n - 1 then chr(10) || ']' else ',' end as value from o""")
def json_array_lines(spark, sf_dir):
    return SF.json_array(read(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


@query("""select source as subject, '{' || string_agg('"' || doc_id || '":"' || coalesce(lang, 'none') || '"', ',' order by cast(doc_id as varchar)) || '}' as results from documents group by source""")
def evaluation_files(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("subject"), "doc_id", F.coalesce("lang", F.lit("none")).alias("pred"))
    return RC.evaluation_results(rows, "subject", "doc_id", "pred")


@query("""with a as (select source, 100.0::double * avg(case when lang = 'en' then 1.0::double else 0 end) as s from documents group by source) select lpad(source, cast(greatest(15, length(source)) as integer), ' ') || ': ' || printf('%.2f', s) as value from a""")
def evaluation_log(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("source").agg((100.0 * F.avg(F.coalesce((F.col("lang") == "en").cast("double"), F.lit(0.0)))).alias("s"))
    return RC.evaluation_log(rows, "source", "s")


@query("""select event_id, '{"current_steps":' || event_id || case when event_id % 3 = 0 then '' else ',"loss":' || user_id end || ',"state":"' || event_type || '"}' as value from events""")
def trainer_log_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("current_steps"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("loss"), F.col("event_type").alias("state"))
    return rows.select("event_id", F.to_json(F.struct("current_steps", "loss", "state"), {"ignoreNullFields": "true"}).alias("value"))


@query("""select 'papers' as _dataset_name, coalesce(title, '') as prompt, coalesce(abstract, '') as response from raw_papers""")
def registered_columns(spark, sf_dir):
    """A file found by its registry entry, with the columns that the entry names."""
    import json

    path = _folder(spark, "papers")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    read(spark, sf_dir, "raw_papers").select(text("title"), text("abstract")).write.parquet(path)
    entries = SF.registry(json.dumps({"papers": {"file_name": path, "columns": {"prompt": "title", "response": "abstract"}}, "other": {"hf_hub_url": "x"}}))
    (found,) = SF.lookup(entries, ["papers"])
    rows = SF.rename(SF.read_dataset(spark, found.location), found)
    return rows.select("_dataset_name", "prompt", "response")


@query(f"""with {_PAIRS} select 'pairs' as dataset, coalesce(prompt, '') as prompt, coalesce(reply, '') as response from pairs""")
def engine_load(spark, sf_dir):
    """A dataset of the engine, read and converted by name."""
    path = _folder(spark, "pairs")
    text = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    _pairs(spark, sf_dir).select(text("prompt", "instruction"), text("reply", "output")).write.parquet(path)
    rows = G.load(spark, G.Entry("pairs", path, converter="alpaca"))
    return rows.select(F.col("_dataset_name").alias("dataset"), F.col("_prompt")[0]["content"].alias("prompt"), F.col("_response")[0]["content"].alias("response"))


@query("select distinct event_id, event_type from events")
def stream_ingest(spark, sf_dir):
    """Events delivered twice as files, taken in by a stream that keeps each key once."""
    source, store, ck = (_folder(spark, n) for n in ("incoming", "store", "checkpoint"))
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (rows, rows.where("event_id % 7 = 0")):
        part.write.mode("append").json(source)
        ST.ingest(spark, source, "event_id long, event_type string", store, ck, key="event_id").awaitTermination()
    return spark.read.parquet(store)


@query("select event_id as step, round(user_id / 2.0, 1) as loss from events where user_id % 4 <> 0")
def loss_series(spark, sf_dir):
    """The losses of a log of events, those of 0 and the missing ones left out."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("current_steps"), F.when(F.col("user_id") % 8 != 0, F.when(F.col("user_id") % 4 == 0, 0.0).otherwise(F.col("user_id") / 2.0)).alias("loss"))
    return ST.losses(rows).select("step", F.round("loss", 1).alias("loss"))


@query(f"""with {_DIALOGUES}, {_SOUND} select session_id, block, cast(i as integer) as pair, 'User: ' || coalesce(m[2 * i + 1].content, '') || chr(10) || chr(10) || 'Assistant:' as prompt, coalesce(m[2 * i + 2].content, '') || '</s>' as response
    from (select session_id, block, m, unnest(range(0, len(m) // 2)) as i from g where good) where i > 0""")
def render_turn_pairs(spark, sf_dir):
    """The later turns of every sound dialogue."""
    from textloom.operators.templates import TEMPLATES, turn_pairs

    _, msgs = A.split_system(A.turns(F.col("m"), "role", "content"))
    plain = F.transform("m", lambda x, i: A.message(F.when(i % 2 == 0, "user").otherwise("assistant"), x["content"]))
    rows = dialogues(spark, sf_dir).select("session_id", "block", msgs.alias("m")).where(A.is_sound(F.col("m"))).withColumn("m", plain)
    out = rows.select("session_id", "block", F.posexplode(turn_pairs(TEMPLATES["deepseek"], F.col("m"))).alias("pair", "p"))
    return out.where("pair > 0").select("session_id", "block", "pair", "p.prompt", "p.response")


@query(f"""with {_PAIRS} select id, '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(reply, '') as added, coalesce(ltrim(reply, chr(10)), '') as removed from pairs""")
def thoughts(spark, sf_dir):
    text = F.coalesce("reply", F.lit(""))
    marked = F.concat(F.lit("<think>why\nso</think>\n\n"), text)
    return _pairs(spark, sf_dir).select("id", X.add_thought(text).alias("added"), X.remove_thought(marked).alias("removed"))


@query("""select o_orderkey, o_orderpriority || chr(10) || 'A. yes' || chr(10) || 'B. no' || case when o_orderkey % 2 = 0 then chr(10) || 'C. maybe' else '' end || chr(10) || 'Answer:' as prompt from orders""")
def choice_prompts(spark, sf_dir):
    choices = {"A": F.lit("yes"), "B": F.lit("no"), "C": F.when(F.col("o_orderkey") % 2 == 0, F.lit("maybe"))}
    return read(spark, sf_dir, "orders").select("o_orderkey", M.choice_prompt(F.col("o_orderpriority"), choices).alias("prompt"))


@query("""with a as (select o_orderkey, [o_custkey % 3, o_custkey % 5, o_orderkey % 2, 1] as p, [-100, o_custkey % 3, case when o_orderkey % 4 = 0 then -100 else 1 end, o_orderkey % 2] as y from orders),
    c as (select o_orderkey, list_filter([1, 2, 3], lambda i: y[i + 1] <> -100) as k, list_filter([1, 2, 3], lambda i: y[i + 1] <> -100 and p[i] = y[i + 1]) as h from a) select o_orderkey, round(len(h)::double / len(k), 6) as accuracy from c""")
def token_accuracies(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pred = F.array(c % 3, c % 5, k % 2, F.lit(1).cast("long"))
    labels = F.array(F.lit(-100).cast("long"), c % 3, F.when(k % 4 == 0, -100).otherwise(1).cast("long"), k % 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(M.token_accuracy(pred, labels), 6).alias("accuracy"))


_SEGMENTED = "regexp_extract_all({}, '[㐀-鿿豈-﫿぀-ヿ가-힯]|[^\\s㐀-鿿豈-﫿぀-ヿ가-힯]+')"


@query(f"""with {_PAIRS}, w as (select id, {_SEGMENTED.format("coalesce(reply, '')")} as a, {_SEGMENTED.format("coalesce(prompt, '')")} as b from pairs), g as (select id, list_distinct(a) as a1, list_distinct(b) as b1, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || chr(1) || a[i + 1])) as a2, list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || chr(1) || b[i + 1])) as b2 from w)
    select id, round(case when len(list_intersect(a1, b1)) = 0 then 0.0::double else 200.0::double * len(list_intersect(a1, b1)) / (len(a1) + len(b1)) end, 4) as rouge_1, round(case when len(list_intersect(a2, b2)) = 0 then 0.0::double else 200.0::double * len(list_intersect(a2, b2)) / (len(a2) + len(b2)) end, 4) as rouge_2 from g""")
def rouge_scores(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("s", M.text_scores("reply", "prompt"))
    return rows.select("id", F.col("s.rouge_1").alias("rouge_1"), F.col("s.rouge_2").alias("rouge_2"))


@query("""with m as (select doc_id, source, case source when 'workshop_archive' then 'archive' else null end as category from documents) select doc_id, category from m""")
def dictionary_lookup(spark, sf_dir):
    return M.named(read(spark, sf_dir, "documents"), "source", {"workshop_archive": {"name": "W", "category": "archive"}}).select("doc_id", "category")


@query("""select id, year from (select distinct trim(id) as id, 1 as year from raw_papers where id is not null and trim(id) <> '' and length(id) % 2 = 0) union all select distinct trim(id), 2 from raw_papers where id is not null and trim(id) <> '' and length(id) % 2 = 1 and trim(id) not in (select trim(id) from raw_papers where id is not null and length(id) % 2 = 0)""")
def accumulated_log(spark, sf_dir):
    """Ids of even length as an earlier run's, the others as this one's."""
    rows = read(spark, sf_dir, "raw_papers").where("id is not null and trim(id) <> ''")
    part = lambda even, run: rows.where(f"length(id) % 2 = {0 if even else 1}").select(F.trim("id").alias("id"), F.lit(run).alias("year")).distinct()
    return P.accumulated(part(True, 1), part(False, 2))


@query(f"""with {_CHAT} select id, session_id from (select *, row_number() over (order by id) as o from chat) where o <= 50""")
def head_rows(spark, sf_dir):
    return SF.head(_chat(spark, sf_dir).select("id", "session_id"), ["id"], 50)
