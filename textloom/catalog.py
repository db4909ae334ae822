"""The core's queries over the driver tables, and their SQL.

Each runs over its whole tables; a limit stands only where it is the feature. Where SQL cannot say
the same (sequential packing, text metrics), there is none and the tests hold a brute-force check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.common import read
from textloom.functions import losses as L
from textloom.functions import metrics as M
from textloom.functions import text as X
from textloom.operators import align as A
from textloom.operators import chunking as C
from textloom.operators import encode as E
from textloom.operators import mixing as MX
from textloom.operators import store as S
from textloom.operators.sequence import with_ordinal, with_previous
from textloom.operators.vector import cosine_distance
from textloom.plans import curation as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# --- retrieval -------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _nearest(vecs: DataFrame, query_: DataFrame, k: int) -> DataFrame:
    return (
        vecs.join(F.broadcast(query_))  # one row
        .select("vec_id", F.round(cosine_distance(F.col("v"), F.col("q")), 6).alias("distance"))
        .orderBy("distance", "vec_id")
        .limit(k)
    )


@query("""select e.vec_id, round(list_cosine_distance(e.embedding::double[], q.embedding::double[]), 6) as distance
    from embeddings e, (select embedding from embeddings where vec_id = 0) q order by 2, 1 limit 10""")
def retrieval_topk(spark, sf_dir):
    vecs = _vectors(spark, sf_dir)
    return _nearest(vecs, vecs.where("vec_id = 0").select(F.col("v").alias("q")), 10)


@query("""select e.vec_id, round(list_cosine_distance(e.embedding::double[], q.embedding::double[]), 6) as distance
    from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label = 3 order by 2, 1 limit 5""")
def retrieval_topk_filtered(spark, sf_dir):
    vecs = _vectors(spark, sf_dir)
    return _nearest(vecs.where("label = 3"), vecs.where("vec_id = 0").select(F.col("v").alias("q")), 5)


# --- papers ------------------------------------------------------------------------------------------------

_SPACE_SQL = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
_CLEAN = lambda c: f"trim(regexp_replace({c}, '{_SPACE_SQL}', ' ', 'g'))"
_TOKENS = lambda c: f"list_filter(string_split(coalesce({_CLEAN(c)}, ''), ' '), lambda x: x <> '')"
_KEYWORDS = f"list_concat({_TOKENS('lower(title)')}, {_TOKENS(chr(39).join(['replace(lower(categories), ', '.', ', ', '', ')']))})"
_COUNT = lambda terms: " + ".join(f"len(list_filter(k, lambda x: contains(x, '{t}')))" for t in terms)
_YEAR = """case when regexp_matches(split_part(split_part(id, 'v', 1), '.', 1), '^[0-9]{4,}$') then
    (case when cast(substr(id, 1, 2) as integer) >= 91 then 1900 else 2000 end) + cast(substr(id, 1, 2) as integer) end"""
_PAPERS = f"""papers as (select id, m.t title, m.a abstract, m.c categories, {_YEAR} as year from (select id, min(struct_pack(t := title, a := abstract, c := categories)) m from raw_papers where id is not null group by id))"""


@query(f"select distinct id, {_CLEAN('title')} as title, {_CLEAN('abstract')} as abstract from raw_papers")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "raw_papers").select("id", X.clean(F.col("title")).alias("title"), X.clean(F.col("abstract")).alias("abstract")).distinct()


@query(f"""with k as (select distinct id, {_KEYWORDS} as k from raw_papers),
    s as (select id, {_COUNT(X.TERMS["rag"])} + case when ({_COUNT(X.TERMS["retrieval"])}) > 0 and ({_COUNT(X.TERMS["generation"])}) > 0 then 2 else 0 end as rag, {_COUNT(X.TERMS["rl"])} as rl, {_COUNT(X.TERMS["agentic_workflow"])} as aw, {_COUNT(X.TERMS["kg"])} as kg from k)
    select distinct id, cast(rag as integer) as rag, cast(rl as integer) as rl, cast(aw as integer) as agentic_workflow, cast(kg as integer) as kg,
      case when greatest(rag, rl, aw, kg) = 0 then null when rag = greatest(rag, rl, aw, kg) then 'rag' when rl = greatest(rag, rl, aw, kg) then 'rl' when aw = greatest(rag, rl, aw, kg) then 'agentic_workflow' else 'kg' end as best,
      case when greatest(rag, rl, aw, kg) = 0 then 0.0::double else least(1.0::double, round(0.5::double + 0.1::double * greatest(rag, rl, aw, kg), 10)) end as confidence from s""")
def keyword_score(spark, sf_dir):
    scores = X.keyword_scores(F.col("k"))
    rows = read(spark, sf_dir, "raw_papers").select("id", X.keywords(F.col("title"), F.col("categories")).alias("k"))
    rows = rows.select("id", *[c.cast("int").alias(n) for n, c in scores.items()])
    best, confidence = X.best_class({n: F.col(n) for n in scores})
    return rows.withColumns({"best": best, "confidence": confidence}).distinct()


@query(f"""select distinct id from (select id, {_KEYWORDS} as k from raw_papers) where list_has_any(k, [{", ".join(f"'{c}'" for c in X.AI_CATEGORIES)}])""")
def category_overlap_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "raw_papers")
    return rows.where(F.arrays_overlap(X.keywords(F.col("title"), F.col("categories")), F.array(*map(F.lit, X.AI_CATEGORIES)))).select("id").distinct()


@query(f"select distinct id, cast({_YEAR} as integer) as year from raw_papers")
def year_from_id(spark, sf_dir):
    return read(spark, sf_dir, "raw_papers").select("id", X.year_of(F.col("id")).alias("year")).distinct()


_ACCEPT = """(greatest(coalesce(confidence['rag'], 0), coalesce(confidence['rl'], 0), coalesce(confidence['agentic_workflow'], 0), coalesce(confidence['kg'], 0)) >= 0.65
    and (coalesce(is_rag, false) or coalesce(is_rl, false) or coalesce(is_agentic_workflow, false) or coalesce(is_kg, false)))"""
_LABELS = """array_to_string(list_filter([case when is_rag then 'RAG' end, case when is_rl then 'RL' end, case when is_agentic_workflow then 'Agentic Workflow' end, case when is_kg then 'Knowledge Graph' end], lambda x: x is not null), ',')"""
_DECISIONS = f"""decisions as (select id, max(struct_pack(a := coalesce({_ACCEPT}, false), l := coalesce({_LABELS}, ''))) m from classifier_output where id is not null group by id)"""


@query(f"with {_DECISIONS} select id, m.a as accept, m.l as labels from decisions")
def confidence_accept(spark, sf_dir):
    return P.decisions(read(spark, sf_dir, "classifier_output"))


@query(f"""with {_PAPERS}, {_DECISIONS}, c as (select id, {_CLEAN("title")} as title, {_CLEAN("abstract")} as abstract, categories, year, {_KEYWORDS} as k from papers)
    select c.id, title, categories, cast(year as integer) as year, m.l as labels from c join decisions d on c.id = d.id
    where length(coalesce(abstract, '')) > 0 and year >= 2024 and m.a and list_has_any(k, [{", ".join(f"'{c}'" for c in X.AI_CATEGORIES)}])""")
def curation_pipeline(spark, sf_dir):
    return P.curate(read(spark, sf_dir, "raw_papers"), read(spark, sf_dir, "classifier_output"))


@query(f"with {_PAPERS}, {_DECISIONS} select p.id, cast(year as integer) as year from papers p join decisions d on p.id = d.id where m.a order by p.id limit 150")
def accept_quota(spark, sf_dir):
    kept = P.papers(read(spark, sf_dir, "raw_papers")).join(P.decisions(read(spark, sf_dir, "classifier_output")).where("accept"), "id")
    return P.quota(kept.select("id", "year"), "id")


@query("select distinct id, title from raw_papers where id is not null and trim(id) not in (select trim(id) from classifier_output where id is not null and trim(id) <> '')")
def anti_join_processed(spark, sf_dir):
    done = read(spark, sf_dir, "classifier_output").select(F.trim("id").alias("_id")).where("_id <> ''").distinct()
    rows = read(spark, sf_dir, "raw_papers").where("id is not null")
    return rows.join(done, F.trim(rows["id"]) == done["_id"], "left_anti").select("id", "title").distinct()


# --- chunks and stores ---------------------------------------------------------------------------------------

_WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


def _words(c: str):
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")


@query(f"""with t as (select doc_id, {_WORDS_SQL} as w from documents), s as (select doc_id, w, unnest(range(0, case when len(w) = 0 then 0 when len(w) <= 200 then 1 else cast(ceil((len(w) - 200) / 180.0) as bigint) + 1 end)) as i from t)
    select doc_id, cast(i as integer) as chunk_id, array_to_string(w[i * 180 + 1 : i * 180 + 200], ' ') as chunk_text from s""")
def chunk_windows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", _words("text").alias("w"))
    return C.token_windows(docs, F.col("w")).select("doc_id", "chunk_id", "chunk_text")


@query(f"""with t as (select source, len({_WORDS_SQL}) as n from documents) select source, count(*) as documents, cast(sum(case when n = 0 then 0 when n <= 200 then 1 else cast(ceil((n - 200) / 180.0) as bigint) + 1 end) as bigint) as chunks from t group by source""")
def chunk_counts(spark, sf_dir):
    n = F.size(_words("text"))
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(C.window_count(n)).alias("chunks"))


@query("""with e as (select chunk_id, min(source) as source, min(chunk_text) as chunk_text from chunk_embeddings where source = 'unknown' and chunk_id is not null group by 1),
    n as (select chunk_id, min(struct_pack(s := source, t := chunk_text)) as m from chunk_embeddings where chunk_id is not null group by 1)
    select * from e union all select chunk_id, m.s, m.t from n where chunk_id not in (select chunk_id from e)""")
def insert_if_absent(spark, sf_dir):
    rows = read(spark, sf_dir, "chunk_embeddings").select("chunk_id", "source", "chunk_text")
    held = rows.where("source = 'unknown' and chunk_id is not null").groupBy("chunk_id").agg(F.min("source").alias("source"), F.min("chunk_text").alias("chunk_text"))
    return S.insert_if_absent(held, rows, "chunk_id", ["source", "chunk_text"])


_CHAT = "chat as (select distinct id, user_id, session_id, role, content, created_at from chat_history where id is not null)"


def _chat(spark, sf_dir: str) -> DataFrame:
    return S.first_per_key(read(spark, sf_dir, "chat_history").where("id is not null").select("id", "user_id", "session_id", "role", "content", "created_at"), "id", ["created_at", "session_id"])


@query(f"""with {_CHAT} select session_id, id, role, content, cast(place as integer) as place from (select *, row_number() over (partition by session_id order by created_at nulls first, id) as place from chat) where place <= 25""")
def session_history(spark, sf_dir):
    return S.oldest(_chat(spark, sf_dir), "session_id", ["created_at", "id"], 25).select("session_id", "id", "role", "content", "place")


@query(f"""with {_CHAT} select u.username, count(c.id) as messages, count(distinct c.session_id) as sessions from users u left join chat c on u.user_id = c.user_id group by u.user_id, u.username""")
def user_activity(spark, sf_dir):
    chat = _chat(spark, sf_dir).where("user_id is not null").groupBy("user_id", "session_id").agg(F.count("id").alias("n"))
    chat = chat.groupBy("user_id").agg(F.sum("n").alias("messages"), F.count("session_id").alias("sessions"))
    return read(spark, sf_dir, "users").join(chat, "user_id", "left").select("username", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query(f"""with {_CHAT} select coalesce(lower(trim(role)), '') as role, coalesce(lower(trim(role)) in ('user', 'assistant'), false) as allowed, count(*) as messages from chat group by 1, 2""")
def role_domain(spark, sf_dir):
    role = F.coalesce(F.lower(F.trim("role")), F.lit(""))
    return _chat(spark, sf_dir).groupBy(role.alias("role"), role.isin("user", "assistant").alias("allowed")).agg(F.count("*").alias("messages"))


@query(f"""with {_CHAT}, n as (select *, row_number() over (order by created_at nulls first, id) - 1 as o from chat where role in ('user', 'assistant'))
    select cast(o + 1 + (select max(doc_id) from documents) as bigint) as id, session_id, role from n""")
def append_with_ids(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    new = _chat(spark, sf_dir).withColumnRenamed("id", "key").select("key", "session_id", "role", "created_at")
    return S.append_messages(old, new, ["created_at", "key"]).select("id", "session_id", "role")


# --- mixing ------------------------------------------------------------------------------------------------

_LANG = "coalesce(lower(lang), 'unknown')"
_NUMBERED = f"""n as (select doc_id, {_LANG} as source, row_number() over (partition by {_LANG} order by doc_id) - 1 as rn, count(*) over (partition by {_LANG}) as n, dense_rank() over (order by {_LANG}) - 1 as source_ord from documents)"""


def _sources(spark, sf_dir: str) -> DataFrame:
    return MX.numbered(read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("unknown")).alias("source")), "source", ["doc_id"])


@query(f"with {_NUMBERED} select row_number() over (order by source_ord, rn) - 1 as pos, doc_id from n")
def mix_concat(spark, sf_dir):
    return with_ordinal(_sources(spark, sf_dir), ["source_ord", "rn"], name="pos").select("pos", "doc_id")


@query(f"with {_NUMBERED} select row_number() over (order by rn, source_ord) - 1 as pos, doc_id from n where rn < (select min(n) from n)")
def mix_under(spark, sf_dir):
    return with_ordinal(MX.interleave_under(_sources(spark, sf_dir)), ["rn", "source_ord"], name="pos").select("pos", "doc_id")


@query(f"""with {_NUMBERED}, s as (select distinct source, n, source_ord from n), r as (select source, n, source_ord, unnest(range(0, (select max(n) from n))) as p from s)
    select r.p as round, r.source, n.doc_id from r join n on n.source = r.source and n.rn = r.p % r.n""")
def mix_over(spark, sf_dir):
    return MX.interleave_over(_sources(spark, sf_dir)).select(F.col("pos").alias("round"), "source", "doc_id")


@query(f"with {_NUMBERED} select row_number() over (order by rn, source_ord) - 1 as pos, doc_id from n")
def mix_once(spark, sf_dir):
    return with_ordinal(_sources(spark, sf_dir), ["rn", "source_ord"], name="pos").select("pos", "doc_id")


@query("""select doc_id, case when row_number() over (order by md5('42:' || doc_id), doc_id) <= (select ceil(count(*) * 0.1) from documents) then 'validation' else 'train' end as split from documents""")
def split_train_val(spark, sf_dir):
    return MX.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 42)


@query("""with o as (select doc_id, row_number() over (order by md5('7:' || doc_id), doc_id) - 1 as o, count(*) over () as total from documents)
    select doc_id, c as copy from (select doc_id, unnest(range(0, cast(floor((1499 - o) / total) as bigint) + 1)) as c from o where o < 1500)""")
def resample_n(spark, sf_dir):
    return MX.resample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 1500, 7)


# --- formats -----------------------------------------------------------------------------------------------

_PAIRS = f"""{_CHAT}, o as (select id, lower(trim(coalesce(role, ''))) as r, content, lag(lower(trim(coalesce(role, '')))) over w as pr, lag(content) over w as pc from chat window w as (partition by session_id order by created_at nulls first, id)),
    pairs as (select id, pc as prompt, content as reply from o where r = 'assistant' and pr = 'user')"""


def _pairs(spark, sf_dir: str) -> DataFrame:
    chat = _chat(spark, sf_dir).select("session_id", "created_at", "id", F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), "content")
    return with_previous(chat, "session_id", ["created_at", "id"], ["role", "content"]).where("role = 'assistant' and has_prev and prev_role = 'user'").select("id", F.col("prev_content").alias("prompt"), F.col("content").alias("reply"))


@query(f"""with {_PAIRS} select id, coalesce(prompt, '') as prompt, reply as response, case when reply is null then 0 else 1 end as responses from pairs""")
def align_alpaca(spark, sf_dir):
    rows = A.align_alpaca(_pairs(spark, sf_dir).select("id", F.col("prompt").alias("instruction"), F.col("reply").alias("output")), ["id"])
    return rows.select("id", F.element_at("_prompt", -1)["content"].alias("prompt"), F.get("_response", F.lit(0))["content"].alias("response"), F.size("_response").alias("responses"))


@query(f"""with {_CHAT}, o as (select id, session_id, lower(trim(coalesce(role, ''))) as r, lag(lower(trim(coalesce(role, '')))) over w as pr from chat window w as (partition by session_id order by created_at nulls first, id))
    select id, coalesce(pr in ('user', 'human', 'tool', 'observation') and r in ('assistant', 'function_call', 'gpt'), false) as sound from o where pr is not null""")
def dialogue_turns_sound(spark, sf_dir):
    chat = _chat(spark, sf_dir).select("session_id", "created_at", "id", F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), "content")
    two = with_previous(chat, "session_id", ["created_at", "id"], ["role", "content"]).where("has_prev")
    rows = two.select("id", F.array(F.struct(F.col("prev_role").alias("from"), F.col("prev_content").alias("value")), F.struct(F.col("role").alias("from"), F.col("content").alias("value"))).alias("conversations"))
    return A.align_sharegpt(rows, ["id"]).select("id", (F.size("_prompt") > 0).alias("sound"))


@query(f"""with {_PAIRS} select id, coalesce(prompt, '') as user_text, coalesce(reply, '') as assistant_text, (case when coalesce(prompt, '') <> '' then 1 else 0 end + case when coalesce(reply, '') <> '' then 1 else 0 end) as messages from pairs""")
def align_v1(spark, sf_dir):
    rows = A.v1_alpaca(_pairs(spark, sf_dir).select("id", F.col("prompt").alias("instruction"), F.col("reply").alias("output")), ["id"])
    text = lambda r: F.coalesce(F.get(F.filter("messages", lambda m: m["role"] == r), F.lit(0))["content"][0]["value"], F.lit(""))
    return rows.select("id", text("user").alias("user_text"), text("assistant").alias("assistant_text"), F.size("messages").alias("messages"))


_LEN = lambda c: f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''))"
_SEQ = f"""{_PAIRS}, l as (select id, {_LEN("prompt")} as s, {_LEN("reply")} as t from pairs),
    b as (select *, least(t, case when t * 2 < 32 then 32 when s * 2 < 32 then 32 - s else cast(floor(32 * (t / (s + t))) as bigint) end) as tt from l),
    c as (select *, least(greatest(32 - tt, 0), s) as ss from b)"""


@query(f"with {_SEQ} select id, cast(ss as integer) as source_len, cast(tt as integer) as target_len from c")
def infer_seqlen(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", F.size(E.token_ids(F.col("prompt"))).alias("s"), F.size(E.token_ids(F.col("reply"))).alias("t"))
    s, t = E.seqlens(F.col("s"), F.col("t"), 32)
    return rows.select("id", s.alias("source_len"), t.alias("target_len"))


@query(f"with {_SEQ} select id, cast(ss + tt as integer) as tokens, cast(ss as integer) as masked, cast(tt as integer) as valid from c where s > 0 and t > 0")
def sft_encode(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", E.token_ids(F.col("prompt")).alias("p"), E.token_ids(F.col("reply")).alias("r")).where((F.size("p") > 0) & (F.size("r") > 0))
    ids, _, labels = E.sft(F.col("p"), F.col("r"), 32)
    rows = rows.select("id", ids.alias("ids"), labels.alias("labels"))
    return rows.select("id", F.size("ids").alias("tokens"), (F.size("labels") - E.valid_tokens(F.col("labels"))).alias("masked"), E.valid_tokens(F.col("labels")).alias("valid"))


@query(f"""with {_PAIRS}, k as (select id, coalesce(reply, '') as reply, cast(floor((row_number() over (order by id) - 1) / 1000) as bigint) as b from pairs)
    select id, case when row_number() over (partition by b order by id) = 1 then last(reply) over (partition by b order by id rows between unbounded preceding and unbounded following) else lag(reply) over (partition by b order by id) end as kl_reply from k""")
def kl_offset(spark, sf_dir):
    rows = with_ordinal(_pairs(spark, sf_dir).select("id", F.coalesce("reply", F.lit("")).alias("reply")), ["id"])
    return rows.select("id", E.shifted_in_batch("reply").alias("kl_reply"))


@query(f"""with o as (select doc_id, row_number() over (order by doc_id) - 1 as o, {_WORDS_SQL} as w from documents), b as (select cast(floor(o / 1000) as bigint) as batch, o, w, coalesce(sum(len(w)) over (partition by floor(o / 1000) order by o rows between unbounded preceding and 1 preceding), 0) as before from o),
    t as (select batch, before + i - 1 as pos, w[i] as word from (select batch, before, w, unnest(range(1, len(w) + 1)) as i from b)),
    g as (select batch, cast(floor(pos / 512) as bigint) as block, string_agg(substr(md5(word), 1, 7), '' order by pos) as s, count(*) as n from t group by 1, 2)
    select batch, block, md5(s) as digest from g where n = 512""")
def pretrain_pack(spark, sf_dir):
    rows = with_ordinal(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    blocks = E.pretrain_blocks(rows, E.token_ids(F.col("text")), 512)
    text = F.array_join(F.transform("input_ids", lambda x: F.lower(F.lpad(F.hex(x), 7, "0"))), "")
    return blocks.select("batch", "block", F.md5(text).alias("digest"))


# --- metrics ---------------------------------------------------------------------------------------------

@query("""select cast(n_chars // 1000 * 1000 as bigint) as bucket, count(*) as n, cast(sum(count(*)) over (order by n_chars // 1000 * 1000) as bigint) as running, round(100.0::double * sum(count(*)) over (order by n_chars // 1000 * 1000) / sum(count(*)) over (), 6) as percent from documents group by n_chars // 1000 * 1000""")
def length_cdf(spark, sf_dir):
    by = read(spark, sf_dir, "documents").groupBy((F.floor(F.col("n_chars") / 1000) * 1000).alias("bucket")).agg(F.count("*").alias("n"))
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # one row a bucket
    return by.select("bucket", "n", F.sum("n").over(run).alias("running"), F.round(F.sum("n").over(run) * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query(f"""with {_SEQ}, n as (select *, row_number() over (order by id) - 1 as o from c where s > 0 and t > 0), g as (select sum(tt) as valid, count(*) * max(ss + tt) as total from n group by floor(o / 8)), r as (select sum(valid) / sum(total) as ratio from g)
    select round(ratio, 9) as ratio, round(3e-4 * sqrt(32.0 * 8 * ratio / 4e6), 12) as lr from r""")
def valid_ratio_lr(spark, sf_dir):
    rows = with_ordinal(sft_encode(spark, sf_dir), ["id"])
    by = rows.groupBy(F.floor(F.col("_ord") / 8)).agg(F.sum("valid").alias("v"), (F.count("*") * F.max("tokens")).alias("t"))
    ratio = by.agg((F.sum("v") / F.sum("t")).alias("r"))
    return ratio.select(F.round("r", 9).alias("ratio"), F.round(L.learning_rate(32, 8, F.col("r")), 12).alias("lr"))


@query(f"""with d as (select distinct p.id, coalesce(nullif(split_part({_CLEAN("p.categories")}, ' ', 1), ''), 'none') as category, coalesce(c.is_rag, false) = (coalesce(c.confidence['rag'], 0) >= 0.65) as correct from raw_papers p join (select distinct id, is_rag, confidence from classifier_output) c on p.id = c.id)
    select coalesce(category, 'Average') as category, count(*) as n, round(100.0::double * avg(case when correct then 1.0::double else 0 end), 6) as accuracy from d group by grouping sets ((category), ())""")
def mc_accuracy_by_category(spark, sf_dir):
    papers = read(spark, sf_dir, "raw_papers").select("id", F.coalesce(F.nullif(F.substring_index(X.clean(F.col("categories")), " ", 1), F.lit("")), F.lit("none")).alias("category"))
    out = read(spark, sf_dir, "classifier_output").select("id", (F.coalesce("is_rag", F.lit(False)) == (X.confidence_of(F.col("confidence"), "rag") >= X.CONFIDENCE)).alias("correct"))
    rows = papers.join(out, "id").distinct()
    return rows.rollup("category").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(F.col("correct").cast("int")), 6).alias("accuracy")).withColumn("category", F.coalesce("category", F.lit("Average")))


@query("""select vec_id, round(exp(list_sum(list_transform(embedding, lambda x: abs(x::double))) / len(embedding)), 6) as perplexity from embeddings""")
def perplexity(spark, sf_dir):
    nll = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(L.perplexity(nll), 6).alias("perplexity"))


@query()
def bleu_rouge(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("s", M.text_scores("reply", "prompt"))
    return rows.agg(*[F.round(F.avg(f"s.{n}"), 4).alias(n) for n in ("bleu_4", "rouge_1", "rouge_2", "rouge_l")])


# --- telemetry -------------------------------------------------------------------------------------------


@query("""with d as (select cast(ts as date) as day, count(*) as n from events group by 1) select day, n, cast(sum(n) over (order by day) as bigint) as done, round(100.0::double * sum(n) over (order by day) / sum(n) over (), 6) as percentage from d""")
def training_progress(spark, sf_dir):
    by = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return by.select("day", "n", F.sum("n").over(run).alias("done"), F.round(F.sum("n").over(run) * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("percentage"))


@query("""select user_id, count(*) as rows, case when date_diff('second', min(ts), max(ts)) > 0 then round(count(*) / date_diff('second', min(ts), max(ts))::double, 9) else 0 end as per_second from events group by 1""")
def throughput(spark, sf_dir):
    span = (F.date_trunc("second", F.max("ts")).cast("timestamp").cast("long") - F.date_trunc("second", F.min("ts")).cast("timestamp").cast("long"))
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("rows"), span.alias("span"))
    return by.select("user_id", "rows", F.when(F.col("span") > 0, F.round(F.col("rows") / F.col("span"), 9)).otherwise(0.0).alias("per_second"))


# --- templates -----------------------------------------------------------------------------------------


@query(f"""with {_PAIRS} select id, '<|im_start|>user' || chr(10) || coalesce(prompt, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt_text, coalesce(reply, '') || '<|im_end|>' || chr(10) as response_text from pairs""")
def render_chatml(spark, sf_dir):
    from textloom.operators.templates import TEMPLATES, one_turn

    rows = A.align_alpaca(_pairs(spark, sf_dir).select("id", F.col("prompt").alias("instruction"), F.coalesce("reply", F.lit("")).alias("output")), ["id"])
    prompt, response = one_turn(TEMPLATES["chatml"], F.concat("_prompt", "_response"), F.col("_system"))
    return rows.select("id", prompt.alias("prompt_text"), response.alias("response_text"))


@query(f"""with {_PAIRS} select id, '<s>[INST] ' || coalesce(prompt, '') || '[/INST]' as prompt_text, ' ' || coalesce(reply, '') || '</s>' as response_text from pairs""")
def render_mistral(spark, sf_dir):
    from textloom.operators.templates import TEMPLATES, one_turn

    rows = A.align_alpaca(_pairs(spark, sf_dir).select("id", F.col("prompt").alias("instruction"), F.coalesce("reply", F.lit("")).alias("output")), ["id"])
    prompt, response = one_turn(TEMPLATES["mistral"], F.concat("_prompt", "_response"), F.col("_system"))
    return rows.select("id", prompt.alias("prompt_text"), response.alias("response_text"))


