"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.binding import bind
from textloom.llm import collocations, decontamination, jaccard_join, language_id, line_dedup, packing, periodic_runs, quality, repeats, secret_scan, sharding, token_counts, warc
from textloom.llm.common import table
from textloom.session import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens along a Hilbert curve."""
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.find_secrets(table(spark, folder, "documents"))


def op3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicates among all documents."""
    return jaccard_join.link_documents(table(spark, folder, "documents"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return language_id.identify_languages(table(spark, folder, "documents"))


def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated 100-byte strings removed from all documents."""
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and perplexity bands over all documents."""
    return quality.score_documents(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of all documents, with the pieces and scores of a public model."""
    pieces = token_counts.piece_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, folder, "documents"), pieces)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived and read back."""
    archive = scratch_folder(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), archive)
    records = warc.read_warc(spark, archive).filter("record_type <> 'gap'")
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op9_shard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 40 shards."""
    return sharding.shard_records(table(spark, folder, "documents"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


def with_periodic_tails(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` where every document whose id has a checksum that ends in 0 repeats a stretch of its words to its end."""
    checksum = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))

    def folded(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.expr(f"{_CHECKSUM} div 10")
        first = F.greatest(n, F.lit(1))
        return bind(g % first, lambda a: bind(F.floor((n - a) / (3 + g % 8)) + 1, lambda p: F.array_join(
            F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")))

    return documents.select("doc_id", F.when(checksum % 10 == 0, bind(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), folded)).otherwise(F.col("text")).alias("text"))


_CHECKSUM = "crc32(encode(cast(doc_id as string), 'UTF-8'))"


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which have a periodic tail by definition of the query."""
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return periodic_runs.find_runs(with_periodic_tails(table(spark, folder, "documents"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(runs, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines that stand in ten of them or more."""
    kept = line_dedup.drop_frequent_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of each language, over all documents."""
    return collocations.collocations(table(spark, folder, "documents"))


def registered() -> dict[str, Query]:
    numbered = (op1_pack, op2_secrets, op3_jaccard, op4_language, op5_repeats, op6_quality, op7_token_counts, op8_warc, op9_shard, op10_decontaminate, op11_runs, op12_lines, op13_phrases)
    return {f.__name__: f for f in numbered}


_WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p),
w as (select payload_digest, max(page_id) as whole from d where payload_bytes >= 1000 group by 1)
select d.page_id, payload_bytes, d.payload_digest,
  case when whole is null or whole = page_id then 'response' else 'revisit' end as record_type,
  case when whole <> page_id then whole end as refers_to
from d left join w on d.payload_digest = w.payload_digest and payload_bytes >= 1000
"""

_JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, hash(array_to_string(ws[i:i + 3], ' ')) as g
  from w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as r(i) where len(ws) > 0),
n as (select doc_id, count(*)::bigint as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
p as (select a, b from e union all select b, a from e),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, p.b from r join p on r.reach = p.a)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach) as component_id
from r left join n using (doc_id) group by 1
"""

_DECONTAMINATION_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
iw as (
  select distinct item_id, least(len(ws), 13) as m, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') as g
  from b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as r(i) where len(ws) > 0),
dw as (
  select doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') as g
  from w, (select distinct m from iw) as k(m), unnest(range(1, len(ws) - m + 2)) as r(i) where len(ws) >= m),
h as (select doc_id, i, dw.m, item_id from dw join iw on dw.g = iw.g and dw.m = iw.m),
n as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ks from (select distinct doc_id, item_id::varchar as k from h) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ks, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join n using (doc_id) left join t using (doc_id)
"""


# The checksum is that of zip files: bytes from the left, eight conditional shifts by a fixed polynomial each.
_RUNS_SQL = r"""
with recursive digits as (
  select doc_id, text, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint) as b from documents),
crc as (
  select doc_id, text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda v, ignored: xor(v >> 1, (v & 1) * 3988292384)))) as h
  from digits),
w0 as (
  select doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from crc),
w1 as (select *, len(ws) as n, g % greatest(len(ws), 1) as a from w0),
w2 as (select *, 1 + (n - a) // (3 + g % 8) as p from w1),
w as (
  select doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: case when i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end) else ws end as ws from w2),
t as (select doc_id, n, unnest(ws) as word, unnest(range(n)) as i from w),
same as (select x.doc_id, y.i - x.i as q, x.i from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and (y.i - x.i) * 4 <= x.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from same),
runs as (
  select doc_id, start, length, min(q) as period
  from (select doc_id, q, min(i) as start, count(*) + q as length from islands group by doc_id, q, island)
  where length >= greatest(6, 4 * q) group by 1, 2, 3),
best as (
  select * from runs qualify row_number() over (partition by doc_id order by length::double / period desc, start, period) = 1),
listed as (
  select doc_id, count(*)::bigint as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines from runs group by 1),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select t.doc_id, string_agg(word, ' ' order by t.i) as words from t left join gone on gone.doc_id = t.doc_id and gone.i = t.i where gone.i is null group by 1)
select w.doc_id, coalesce(n_runs, 0) as n_runs, start::bigint as start, length::bigint as length, period::bigint as period,
  (1000 * length // period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from w left join listed using (doc_id) left join best using (doc_id) left join kept using (doc_id)
"""


_LINES_SQL = r"""
with l as (
  select doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
f as (select k from l where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines, count(f.k)::bigint as n_dropped,
  sha256(coalesce(string_agg(case when f.k is null then line end, chr(10) order by i), '')) as kept_sha256
from l left join f on l.k = f.k group by doc_id
"""


_PHRASES_SQL = r"""
with p as (
  select row_number() over () as piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws
  from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
n as (select lang, sum(len(ws))::bigint as n from p group by 1),
o as (select lang, ws[i:i + m - 1] as g, m from p, (values (1), (2), (3), (4), (5)) as s(m), unnest(range(1, len(ws) - m + 2)) as r(i)),
f as (select lang, g, m, count(*)::bigint as a from o group by all having count(*) >= 100),
c as (
  select x.lang, x.g, x.m, x.a, k, u.a as l, v.a as r, (1000::hugeint * x.a * n) // (u.a::hugeint * v.a) as score, n
  from f x join n using (lang), unnest(range(1, x.m)) as s(k), f u, f v
  where x.m > 1 and u.lang = x.lang and v.lang = x.lang and u.m = k and v.m = x.m - k and u.g = x.g[1:k] and v.g = x.g[k + 1:]),
w as (select * from c qualify row_number() over (partition by lang, g order by score, k) = 1),
d as (
  select lang, g[1:m - 1] as g, a from f where m > 2 union all select lang, g[2:] as g, a from f where m > 2),
k as (select * from w where not exists (select 1 from d where d.lang = w.lang and d.g = w.g and d.a = w.a))
select lang, row_number() over (partition by lang order by score desc, a desc, encode(array_to_string(g, ' '))) as rank,
  array_to_string(g, ' ') as phrase, a, l, r, n, score::bigint as score
from k qualify rank <= 2000
"""


def oracles() -> dict[str, str]:
    return {"op11_runs": _RUNS_SQL, "op12_lines": _LINES_SQL, "op13_phrases": _PHRASES_SQL, "op3_jaccard": _JACCARD_SQL, "op8_warc": _WARC_SQL, "op10_decontaminate": _DECONTAMINATION_SQL}
