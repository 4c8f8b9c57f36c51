"""Queries over texts."""

from pyspark.sql import functions as F

from trustlake.functions import text as tx
from trustlake.operators import models, text
from trustlake.plans import fixtures as fx
from trustlake.plans.fixtures import DUCK_VIEWS
from trustlake.plans.registry import query

LEXICON = ("the", "and", "that", "there")

# one row per span: sentences cut at . ! ? followed by blanks, then runs of 32 words
DUCK_VIEWS["v_sentence"] = r"""
select doc_id, trim_s as sentence from (
  select doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))),
    '^\s+|\s+$', '', 'g') as trim_s from documents) s where trim_s <> ''"""
DUCK_VIEWS["v_span"] = r"""
select doc_id, array_to_string(list_slice(tokens, i + 1, i + 32), ' ') as span from (
  select doc_id, tokens, unnest(range(0, greatest(1, len(tokens)), 32)) as i from (
    select doc_id, string_split_regex(sentence, '\s+') as tokens from v_sentence) t) u
union all
select doc_id, '' from documents where doc_id not in (select doc_id from v_sentence)"""


@query("span_counts", """
select doc_id, cast(count(*) as integer) as n_spans, cast(max(length(span)) as integer) as longest,
  cast(sum(length(span)) as bigint) as chars from v_span group by 1
""")
def span_counts(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", tx.spans(F.col("text")).alias("spans"))
    lengths = F.transform("spans", lambda s: F.length(s))
    return docs.select(
        "doc_id",
        F.size("spans").alias("n_spans"),
        F.array_max(lengths).alias("longest"),
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("chars"),
    )


IN_LEXICON = ", ".join(f"'{w}'" for w in LEXICON)


@query("hedge_density", f"""
select doc_id, case when len(w) = 0 then 0::double
  else cast(len(list_filter(w, lambda t: t in ({IN_LEXICON}))) as double) / len(w) end as hedge_density
from (select doc_id, regexp_extract_all(lower(text), '[a-z'']+') as w from documents) q
""")
def hedge_density(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", tx.hedge_density(F.col("text"), LEXICON).alias("hedge_density"))


@query("retrieval_support", r"""
with s as (
  select conv_id, turn, chunk1, chunk2, list_distinct(regexp_extract_all(lower(sentence), '[a-z'']+')) as w from (
    select conv_id, turn, chunk1, chunk2, regexp_replace(unnest(string_split(
      regexp_replace(reply, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') as sentence
    from v_reply) q where sentence <> ''),
p as (select conv_id, turn, case when len(w) = 0 then 1::double else cast(greatest(
    len(list_intersect(w, list_distinct(regexp_extract_all(lower(chunk1), '[a-z'']+')))),
    len(list_intersect(w, list_distinct(regexp_extract_all(lower(chunk2), '[a-z'']+'))))) as double) / len(w) end as v from s)
select conv_id, turn, min(v) as retrieval_support_min, round(avg(v), 9) as retrieval_support_mean from p group by 1, 2
""")
def retrieval_support(spark, sf):
    out = text.retrieval_support(fx.replies(spark, sf), "reply", "chunks")
    return out.select(
        "conv_id", "turn", "retrieval_support_min", F.round("retrieval_support_mean", 9).alias("retrieval_support_mean")
    )


@query("tool_counts", """
select id, cast((case when id%4>=1 and (id+1)%3=0 then 1 else 0 end) + (case when id%4>=2 and (id+2)%3=0 then 1 else 0 end)
   + (case when id%4>=3 and (id+3)%3=0 then 1 else 0 end) as integer) as tool_retry_count,
  cast((case when id%4>=1 and (id+1)%5=0 then 1 else 0 end) + (case when id%4>=2 and (id+2)%5=0 then 1 else 0 end)
   + (case when id%4>=3 and (id+3)%5=0 then 1 else 0 end) as integer) as tool_error_count from v_decision
""")
def tool_counts(spark, sf):
    def call(i):
        n = F.col("id") + i
        error = F.when(n % 5 == 0, "timeout").when(n % 5 == 1, "")
        return F.struct((n % 3 == 0).alias("is_retry"), error.alias("error"))

    made = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= F.col("id") % 4)
    rows = fx.view(spark, sf, "v_decision").select("id", F.transform(made, call).alias("calls"))
    return text.tool_counts(rows, "calls").drop("calls")


SECRETS = "|".join(f"({s})" for s in tx.SECRET_SHAPES)


@query("secret_scan", f"""
with shape as (select distinct doc_id from v_span where regexp_matches(span, '{SECRETS}')),
token as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{16,}}')) as t from documents),
ent as (select doc_id, list_sum(list_transform(list_distinct(string_split(t, '')), lambda c:
   -(cast(length(t) - length(replace(t, c, '')) as double) / length(t))
   * log2(cast(length(t) - length(replace(t, c, '')) as double) / length(t)))) as h from token)
select d.doc_id, case when s.doc_id is not null then 1::double else round(greatest(0::double, least(1::double,
  coalesce((max(h) - 4.5::double) / 1.5::double, 0::double))), 6) end as secret_score
from documents d left join shape s using (doc_id) left join ent e on e.doc_id = d.doc_id group by d.doc_id, s.doc_id
""")
def secret_scan(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", F.round(tx.secret_score(F.col("text")), 6).alias("secret_score"))


PII_RE2 = "|".join((
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"(^|[^0-9])(\+91[- ]?)?[6-9][0-9]{9}([^0-9]|$)",
    r"(^|[^0-9])([0-9][ -]?){13,16}([^0-9]|$)",
    r"(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)",
    r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    r"\b([0-9]{1,3}\.){3}[0-9]{1,3}\b",
))


@query("pii_scan", f"""
select doc_id, case when bool_or(regexp_matches(span, '{PII_RE2}')) then 1::double end as pii_score from v_span group by 1
""")
def pii_scan(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", tx.pii_score(F.col("text")).alias("pii_score"))


@query("last_user_text", """
select conv_id, coalesce(arg_max(text, turn) filter (where role='user'), '') as user_text from conversations group by 1
""")
def last_user_text(spark, sf):
    return text.last_user_text(fx.table(spark, sf, "conversations"))


@query("example_fields", r"""
select conv_id, turn, regexp_replace(regexp_replace(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g') || '''', chr(10))[1],
  '^\s+|\s+$', '', 'g'), '^[''"]+|[''"]+$', '', 'g') as customer from conversations where role = 'user'
""")
def example_fields(spark, sf):
    talk = fx.table(spark, sf, "conversations").filter("role = 'user'")
    prompt = F.concat(
        F.lit("Order record:\n  id: 1\n\nCustomer says: '"), tx.strip(F.col("text")), F.lit("'\n\nReview the request.")
    )
    return talk.select("conv_id", "turn", tx.quoted_after(prompt).alias("customer"))


def labelled_texts(spark, sf):
    return fx.table(spark, sf, "documents").join(
        spark.read.schema("doc_id bigint, quality int, toxic int").parquet(f"{sf}/labels.parquet"), "doc_id"
    )


@query("text_model_scores")
def text_model_scores(spark, sf):
    """A classifier fitted on all labelled documents scores all documents."""
    model = models.fit_text_classifier(labelled_texts(spark, sf), "text", F.col("toxic") > 0)
    scored = model.transform(fx.table(spark, sf, "documents"), "text", "policy_score")
    return scored.select("doc_id", F.round("policy_score", 6).alias("policy_score"), "policy_score_unavailable")


@query("text_model_order", "select true as toxic_higher, count(*) filter (where toxic > 0) as toxic_texts from labels")
def text_model_order(spark, sf):
    """On the texts it was fitted on, the classifier's mean score is higher for the toxic ones."""
    rows = labelled_texts(spark, sf)
    scored = models.fit_text_classifier(rows, "text", F.col("toxic") > 0).transform(rows, "text", "p")
    toxic = F.col("toxic") > 0
    return scored.agg(
        (F.avg(F.when(toxic, F.col("p"))) > F.avg(F.when(~toxic, F.col("p")))).alias("toxic_higher"),
        F.count_if(toxic).alias("toxic_texts"),
    )


@query("merge_pii", """
select doc_id, case when doc_id % 3 = 0 then hit when doc_id % 3 = 1 then greatest(coalesce(hit, 0), entity) end as pii_score
from (select doc_id, case when doc_id % 2 = 0 then cast(1 as double) end as hit, cast(n_chars % 100 as double) / 100 as entity from documents) q
where doc_id % 3 <> 2 union all
select doc_id, case when doc_id % 2 = 0 then cast(1 as double) end from documents where doc_id % 3 = 2
""")
def merge_pii(spark, sf):
    """Shape hits merged with entity scores that are there for a third of the rows."""
    hit = F.when(F.col("doc_id") % 2 == 0, F.lit(1.0))
    entity = (F.col("n_chars") % 100).cast("double") / 100
    score = text.merge_pii(hit, entity, F.col("doc_id") % 3 == 1)
    return fx.table(spark, sf, "documents").select("doc_id", score.alias("pii_score"))


HEAD = [((i * 37) % 21 - 10) / 10 for i in range(64)]


@query("policy_head_score", """
select vec_id, round(1/(1+exp(-list_sum(list_transform(range(0, 64), lambda i:
  cast(embedding[i+1] as double) * (cast((i*37)%21 - 10 as double) / 10))))), 6) as policy_score from embeddings
""")
def policy_head_score(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    return vectors.select("vec_id", F.round(text.linear_head(F.col("embedding"), HEAD), 6).alias("policy_score"))
