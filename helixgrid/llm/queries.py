"""The queries of the operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .byte_bpe import bpe_round_trip
from .language import language_id
from .licenses import scan_licenses
from .merkle import merkle_manifest
from .near_dup import near_duplicates
from .packing import pack
from .pieces import sp_round_trip
from .quality import quality_rules
from .resample import resample
from .token_counts import token_counts
from .token_files import token_file_round_trip
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; see token_counts for nulls, empties and repeats."""
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; see near_duplicates."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates in all documents; see scan_licenses."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; see bpe_round_trip."""
    return bpe_round_trip(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth one; see nearest."""
    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and learned decision list over all documents; see quality_rules."""
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; see pack."""
    return pack(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back; see token_file_round_trip."""
    return token_file_round_trip(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; see toxicity."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; see language_id."""
    return language_id(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn by their weight under the benchmark's distribution; see resample."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded as pieces and decoded again; see sp_round_trip."""
    return sp_round_trip(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents with proofs, checked against tampered rows; see merkle_manifest."""
    return merkle_manifest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_minhash_near_dedup, op3_license_scan, op4_byte_bpe, op5_nearest_neighbours, op6_quality_rules, op7_best_fit_packing, op8_token_files, op9_toxicity, op10_language_id, op11_importance_resampling, op12_sentencepiece, op13_merkle_manifest)}


#: All pairs of documents by their exact shingle sets, and what links reach.
_NEAR_DUPLICATES = r"""with recursive d as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d),
    n as (select doc_id, count(*) n from s group by 1),
    p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
    e as (select a, b from l union all select b, a from l),
    r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a),
    m as (select a doc_id, min(b) component_id from r group by 1)
    select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, component_id, d.doc_id = component_id kept from d join m using (doc_id) left join n using (doc_id)"""


#: The table of a byte-wise crc32 (reflected polynomial EDB88320), and the crc32 of bytes given as numbers.
_CRC = r"""t8 as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) c from (select unnest(range(256)) i)))"""


def _crc(text: str, table: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: cast('0x' || substr(hex(encode({text})), 2 * k + 1, 2) as bigint))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"


_RESAMPLING = rf"""with {_CRC},
    d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
    a as (select r, unnest(w) w from d),
    b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from benchmark),
    v as (select w, {_crc("w", "t8.t")} % 10000 h from (select w from a union select w from b), t8),
    s as (select h, count(*) s from a join v using (w) group by 1), t as (select h, count(*) t from b join v using (w) group by 1),
    n as (select (select count(*) from a) s, (select count(*) from b) t),
    g as (select s.h, cast(floor(1000 * ln((coalesce(t.t, 0) + 1) * (n.s + 10000)::double / ((s.s + 1) * (n.t + 10000)::double))) as bigint) g from s left join t using (h), n),
    x as (select r, count(*) n, sum(g) g from a join v using (w) join g using (h) group by 1),
    y as (select d.r, doc_id, coalesce(n, 0) n_features, coalesce((g - ((g % n) + n) % n) // n, 0) weight, cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) h from d left join x using (r)),
    z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) as bigint) score from y),
    e as (select r, row_number() over (order by score desc, doc_id) k from z where n_features >= 20)
    select doc_id, cast(n_features as bigint) n_features, cast(weight as bigint) weight, cast(score as bigint) score, case when k <= (select count(*) * 10 // 100 from e) then k end rank from z left join e using (r)"""

#: Trees as lists of levels, one row for each source; the same for the tree over sources.
_MERKLE = rf"""with recursive {_CRC},
    f as (select doc_id, source, lang, n_chars, text, case when doc_id is not null and {_crc("doc_id::varchar", "t8.t")} % 2 = 0 then replace(text, chr(10), '') else text end changed from documents, t8),
    l as (select doc_id, source, sha256(p || coalesce(strlen(text) || ':' || text, '-')) leaf, sha256(p || coalesce(strlen(changed) || ':' || changed, '-')) tampered
      from (select *, concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) p from f)),
    o as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 k from l),
    up(source, level, nodes) as (select source, 0, list(leaf order by k) from o group by source
      union all select source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) from up where len(nodes) > 1),
    levels as (select source, list(nodes order by level) t, max_by(nodes, level)[1] subroot from up group by source),
    named as (select *, row_number() over (order by source nulls first) - 1 j from levels),
    top(level, nodes) as (select 0, list(subroot order by j) from named
      union all select level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) from top where len(nodes) > 1),
    whole as (select list(nodes order by level) u, max_by(nodes, level)[1] root from top),
    steps as (select o.doc_id, leaf, tampered, subroot, root,
      list_concat(list_transform(range(len(t) - 1), lambda i: {{'at': cast(floor(k / pow(3, i)) as bigint), 'run': t[i + 1]}}), list_transform(range(len(u) - 1), lambda i: {{'at': cast(floor(j / pow(3, i)) as bigint), 'run': u[i + 1]}})) s
      from o join named n on o.source is not distinct from n.source, whole),
    sides as (select * exclude (s), list_transform(s, lambda x: {{'before': coalesce(array_to_string(case when x.at % 3 = 0 then [] else x.run[x.at // 3 * 3 + 1:x.at] end, ''), ''), 'after': coalesce(array_to_string(case when x.at % 3 = 2 then [] else x.run[x.at + 2:x.at // 3 * 3 + 3] end, ''), '')}}) p from steps),
    folded as (select *, list_reduce(list_prepend({{'before': tampered, 'after': ''}}, p), lambda h, x: {{'before': sha256(concat(x.before, h.before, x.after)), 'after': ''}}).before folded_root from sides)
    select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda x: concat(x.before, x.after)), ''), '')) proof_sha256, folded_root, folded_root = root verified from folded"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": _NEAR_DUPLICATES, "op11_importance_resampling": _RESAMPLING, "op13_merkle_manifest": _MERKLE}
