"""One registered query for each operator, over its whole tables with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm import (
    brown, bpe_counts, byte_bpe, circulant, curriculum, edit_decontam, hard_negatives, kn_quality, periodic, pseudonyms, relative_lz, url_rules, warc)
from incidentlens.llm.frames import read
from incidentlens.plans.materialize import shared_dir

# The key that a run's pseudonyms depend on: whoever has it can turn them back, so a real run passes its own.
PSEUDONYM_KEY = "example key of the registered queries"


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, read(spark, sf_dir, "labels")).drop("url")


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op3_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = relative_lz.parse_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.encode("kept_text", "UTF-8"), 256)
    return parsed.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = kn_quality.quality_rules(docs, labels=read(spark, sf_dir, "labels"))
    return judged.drop("text", "lang")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(shared_dir(spark))
    warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return curriculum.mix(docs, keep_text=False)


def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(read(spark, sf_dir, "documents"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The texts that the query judges: of each tenth document (by the id's checksum) the words from one on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        turns = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), turns)), F.lit(1), n - a)
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a), tail)).otherwise("")

    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    # The lambda binds the words, so that they are extracted once.
    again = F.transform(F.array(found), repeated)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_with_periods(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("longest", longest)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.s")).alias("start"), "longest.length",
        (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).alias("exponent_milli"),
        F.sha2(F.encode(F.concat_ws("", F.transform(lines, lambda t: F.concat(t, F.lit("\n")))), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), label=label)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(F.concat_ws(" ", F.col("ids").cast("array<string>")), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_url_rules, op2_pseudonyms, op3_relative_lz, op4_token_counts, op5_edit_decontamination, op6_circulant_minhash,
    op7_perplexity_rules, op8_warc, op9_curriculum, op10_brown_scores, op11_periodic_runs,
    op12_hard_negatives, op13_byte_bpe)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op3_relative_lz": f"""
with docs as (select doc_id, {WORDS} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from docs where len(w) >= 50),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from starts),
firsts as (select k, min(doc_id) as first from windows group by k),
dup as (select doc_id, i from windows join firsts using (k) where doc_id > first),
places as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from docs),
marked as (select p.doc_id, p.word, p.i, d.i is not null as begins
  from places p left join dup d on p.doc_id = d.doc_id and p.i = d.i),
judged as (select doc_id, word, i,
  bool_or(begins) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from marked),
kept as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
  string_agg(word, ' ' order by i) filter (where not gone) as t from judged group by doc_id)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
""",
    "op6_circulant_minhash": f"""
with recursive docs as (select doc_id,
  {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from docs),
sized as (select doc_id, cast(len(s) as bigint) as n from sets),
items as (select doc_id, unnest(s) as g from sets),
often as (select g, count(*) as c from items group by g having count(*) > 1),
-- With the rarest shingles first, two sets of the similarity share one of the first 15 % and one more.
ranked as (select i.doc_id, i.g, row_number() over (partition by i.doc_id order by coalesce(c, 1), i.g) as r
  from items i left join often o on i.g = o.g),
heads as (select k.doc_id, k.g from ranked k join sized z on k.doc_id = z.doc_id where r <= n - (85 * n + 99) // 100 + 1),
pairs as (select distinct a.doc_id as a, b.doc_id as b from heads a join heads b on a.g = b.g and a.doc_id < b.doc_id),
common as (select p.a, p.b, len(list_intersect(x.s, y.s)) as c from pairs p join sets x on x.doc_id = p.a join sets y on y.doc_id = p.b),
links as (select a, b from common join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach(id, root) as (select doc_id, doc_id from documents union select e.b, r.root from reach r join edges e on e.a = r.id where e.b > r.root),
least as (select id, min(root) as root from reach group by id)
select z.doc_id, z.n as n_shingles, l.root as component_id, z.doc_id = l.root as kept
from sized z join least l on l.id = z.doc_id
""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as size from pages),
k as (select page_id, size, sha1(h) as digest, max(page_id) over (partition by h) as keeper from p)
select page_id, cast(size as bigint) as payload_bytes, digest as payload_digest,
  case when size >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
  case when size >= 1000 and page_id <> keeper then keeper end as refers_to
from k
""",
    "op11_periodic_runs": f"""
-- Bytes' checksums, for the crc32 of an id's digits.
with bits as (select range as b, list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), range) as v from range(256)),
crc as (select list(v order by b) as t from bits),
docs as (select doc_id, {WORDS} as w,
  xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint)),
    lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as h from documents, crc),
cut as (select doc_id, w, len(w) as n, h, (h // 10) % greatest(len(w), 1) as a from docs),
own as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n),
    lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end]) else w end as w from cut),
places as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from own),
-- Equal words p apart; words that follow each other in that make a stretch of period p.
pairs as (select x.doc_id, y.i - x.i as p, x.i from places x join places y
  on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
islands as (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as g from pairs),
stretches as (select doc_id, p, min(i) as start, count(*) + p as length from islands group by doc_id, p, g
  having count(*) >= p and count(*) + p >= 12),
runs as (select doc_id, start, length, min(p) as period from stretches group by doc_id, start, length),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from places anti join gone using (doc_id, i) group by doc_id),
best as (select * from runs qualify row_number() over (partition by doc_id order by length desc, start, period) = 1),
texts as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t
  from runs group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli,
  sha256(coalesce(r.t, '')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256
from docs d left join best b on d.doc_id = b.doc_id left join texts r on d.doc_id = r.doc_id left join kept k on d.doc_id = k.doc_id
""",
    "op12_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    cast(list_inner_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
bands as (select p.anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
    cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as int) as rank
  from positives p join scored s on p.anchor_id = s.anchor_id and not same
    and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from bands where rank <= 10
""",
}
