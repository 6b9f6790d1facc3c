"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farfield.llm import decontam, html_diff, langid, lm, mpeg, negatives, ngram_join, packing, pii, quality, rlz_dedup, spelling, urls
from farfield.llm.scratch import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.digest(rlz_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.surrogate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg.describe(mpeg.encode(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "frames", "bad_checksums", "seek_offsets")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_substring_dedup, op3_language_id, op4_packing, op5_pii, op6_lm_scoring, op7_decontamination, op8_quality, op9_media_columns, op10_jaccard_join, op11_spelling_variants, op12_url_filters, op13_hard_negatives)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op2_substring_dedup": f"""
        with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
        h as (select doc_id, unnest(ks) as k, unnest(range(1, len(ks) + 1)) as i from (
            select doc_id, list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) as ks from w where len(ws) >= 50)),
        f as (select k, min(doc_id) as first_id from h group by k),
        d as (select distinct doc_id, i from h join f using (k) where first_id < doc_id),
        g as (select distinct doc_id, unnest(range(i, i + 50)) as p from d),
        x as (select doc_id, unnest(ws) as t, unnest(range(1, len(ws) + 1)) as p from w),
        y as (select x.doc_id, string_agg(t, ' ' order by x.p) as kept, count(*) as n from x left join g on x.doc_id = g.doc_id and x.p = g.p where g.p is null group by x.doc_id)
        select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from w left join y on w.doc_id = y.doc_id""",
    "op10_jaccard_join": f"""
        with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as ws from documents),
        s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
            else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as ss from w),
        e as (select doc_id, len(ss) as n, unnest(ss) as k from s),
        o as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from o where 100 * c >= 90 * (na + nb - c)),
        u as (select x as a, y as b from l union all select y, x from l),
        r as (select doc_id as a, doc_id as b from s union select r.a, u.b from r join u on r.b = u.a),
        m as (select a, min(b) as component_id from r group by a)
        select s.doc_id, cast(len(ss) as bigint) as n_shingles, component_id from s join m on m.a = s.doc_id""",
    "op11_spelling_variants": """
        with recursive steps as (select list(list_reduce(list_prepend(k, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by k) as t from (select range as k from range(256))),
        runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
        each as (select doc_id, run, count(*) as n from runs group by 1, 2),
        hashed as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(code) // 2 + 1), lambda i: ('0x' || code[2 * i - 1:2 * i])::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h
            from (select *, hex(encode(doc_id || ':' || run)) as code from each), steps),
        misspelt as (select n, case when h % 199 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word from hashed),
        words as (select word, cast(sum(n) as bigint) as n from misspelt where length(word) >= 6 group by word having sum(n) >= 5),
        shorter as (select word, n, i, word[1:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
        pairs as (select a.word, a.n, b.word as other, b.n as m from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word
            union select a.word, a.n, b.word, b.n from shorter a join words b on a.rest = b.word union select b.word, b.n, a.word, a.n from shorter a join words b on a.rest = b.word),
        best as (select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from pairs group by word),
        told as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then other end as form, case when m >= 5 * n then m end as form_n from words w left join best b on b.word = w.word),
        chain(word, root) as (select word, word from told union select c.word, t.form from chain c join told t on t.word = c.root where t.form is not null)
        select t.word, form, (select c.root from chain c join told e on e.word = c.root where c.word = t.word and e.form is null) as root, n, n_near, form_n from told t""",
    "op13_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
        n as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as rank
            from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5""",
}
