"""One query per operator, over whole tables; digests are derived from the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, chat, decontam, fim, itq, langid, lexical, licenses, packing, quality, secrets, simhash, toxicity
from riskspark.llm.common import held_out
from riskspark.session import write_through

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BPE_FILE = "byte_bpe_50k.tiktoken"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_line(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.col("places.label")
    score = F.greatest(
        F.coalesce(F.array_max("found.confidence"), F.lit(0.0)),
        F.when(F.size("places") > 0, F.lit(licenses.BASE_CONFIDENCE)).otherwise(F.lit(0.0)),
    )
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("found.label"))).alias("labels"), score.alias("score"),
    )


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(spans_line(base), 256).alias("base_sha256"), spans_line(F.col("spans")).alias("spans"),
    )


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _injected(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.sql(f"select * from values (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') as t(conv_id, turn, role, text)")


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(_injected(spark))
    done = chat.format_conversations(messages)
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


ORACLES["op7_chat"] = f"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length('<|im_start|>') + length({_escaped_sql('role')}) + 1 + length({_escaped_sql('text')}) + length('<|im_end|>') + 1)::bigint as formatted_chars
from said group by conv_id
"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"), "offending")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op3_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = itq.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


_COSINE = """
good as (
    select vec_id, embedding::double[] as v from embeddings
    where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
),
unit as (select vec_id, [x / sqrt(list_dot_product(v, v)) for x in v] as v from good),
links as (
    select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
        and list_dot_product(a.v, b.v) >= 0.9
)"""

ORACLES["op3_itq"] = f"""
with recursive {_COSINE},
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
roots as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join roots r on e.vec_id = r.a left join counts c on e.vec_id = c.a
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical"] = r"""
with said as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
),
sizes as (select doc_id, count(*)::bigint as n from said group by doc_id),
totals as (select count(*)::bigint as docs, sum(n)::bigint as terms from sizes),
norms as (select doc_id, 25 + (75 * n * docs) // terms as m from sizes, totals),
counts as (select doc_id, term, count(*)::bigint as tf from said group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counts, totals group by term, docs),
wanted as (
    select item_id, term, count(*)::bigint as times from (
        select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
    ) group by item_id, term
),
scored as (
    select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from wanted join weights using (term) join counts using (term) join norms using (doc_id) group by item_id, doc_id
),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


@query
def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = write_through(fim.store(table(spark, sf_dir, "documents")), "fim-frames")
    return fim.digests(fim.transform(stored)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLES["op13_fim"] = r"""
with given as (
    select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as hex,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines from documents
),
drawn as (
    select *, len(lines)::bigint as n, ('0x' || hex[1:8])::bigint as h1, ('0x' || hex[9:16])::bigint as h2,
        ('0x' || hex[17:24])::bigint as h3, ('0x' || hex[25:32])::bigint as h4 from given
),
placed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
            when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn
),
parts as (
    select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle, array_to_string(lines[b + 1:n], '') as suffix from placed
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from parts
"""
