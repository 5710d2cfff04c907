"""The pN_ queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoloom.llm.leakage import leaked_items
from ontoloom.llm.mixing import Mixture
from ontoloom.llm.spans import SharedSpans
from ontoloom.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a long run of an item's words, with the item."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("run > 0").select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Run, missing words and coverage of every leaked item, reordered ones included."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their copies."""
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with at least 200 consecutive characters in common."""
    return SharedSpans(table(spark, d, "documents")).pairs()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared with others."""
    return SharedSpans(table(spark, d, "documents")).report()


QUERIES = {f.__name__: f for f in (p6_found, p6_report, p7_mixture, p7_shares, p8_found, p8_report)}

# every window of 200 characters, cut from blocks of 455; equal hashes are compared as texts
_WINDOWS = """t as (select text, min(doc_id) as lead from documents where doc_id is not null and text is not null and length(text) >= 200 group by text),
 b as (select lead, k * 256 as pos, substr(text, k * 256 + 1, 455) as part from (select *, unnest(range(0, (length(text) - 200) // 256 + 1)) as k from t)),
 w as (select lead, pos + i as pos, substr(part, i + 1, 200) as z from (select *, unnest(range(0, length(part) - 199)) as i from b)),
 maybe as (select hash(z) as h from w group by 1 having min(lead) <> max(lead)),
 x as (select lead, pos, z from w where hash(z) in (select h from maybe)),
 same as (select z from x group by z having min(lead) <> max(lead)),
 m as (select distinct d.doc_id as id, t.lead, length(t.text) as n from documents d join t using (text) where d.doc_id is not null)"""

ORACLES: dict[str, str] = {
    "p8_found": f"""with {_WINDOWS}, g as (select distinct lead, z from x semi join same using (z)),
 k as (select min(z) as z from (select z, list(lead order by lead) as l from g group by z) group by l),
 p as (select distinct a.lead as x, b.lead as y from g a join k using (z) join g b using (z) where a.lead < b.lead)
 select distinct least(a.id, b.id) as doc_a, greatest(a.id, b.id) as doc_b from p join m a on a.lead = p.x join m b on b.lead = p.y where a.id <> b.id
 union select distinct a.id, b.id from m a join m b on a.lead = b.lead and a.id < b.id""",
    "p8_report": f"""with {_WINDOWS}, spot as (select distinct lead, pos from x semi join same using (z)),
 cover as (select lead, sum(least(200, coalesce(following - pos, 200))) as chars from (select *, lead(pos) over (partition by lead order by pos) as following from spot) group by lead),
 copies as (select lead, count(*) as k from m group by lead)
 select id as doc_id, n as n_chars, case when k > 1 then n else coalesce(chars, 0) end::bigint as shared_chars, case when k > 1 then n else coalesce(chars, 0) end / n as share, k - 1 as copies
 from m join copies using (lead) left join cover using (lead)""",
}
