"""Sources, writers and column expressions over the given tables: files are written from them to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlab.functions import expr
from variantlab.operators import clean, encode, report
from variantlab.plans.cleaning import _AAC, _variants
from variantlab.plans.common import query, table
from variantlab.plans.features import _ALIGNED, aligned
from variantlab.plans.statistics import r6
from variantlab.sources import sequences, tables
from variantlab.sources.store import Store
from variantlab.tables import scratch

# files of samples


def _sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a processed table: id, variant, target (some None), tags, structures (some no number), then features."""
    part = table(spark, sf_dir, "part").join(_variants(spark, sf_dir).select("p_partkey", "aac"), "p_partkey")
    k = F.col("p_partkey")
    target = F.when(k % 5 != 0, F.col("p_retailprice").cast("string")).otherwise("None")
    return part.select(
        F.col("p_brand").alias("Uniprot Ac"), F.col("aac").alias("AAC"), target.alias("Target value"), F.concat(F.lit("#t:"), F.col("p_size"), F.lit(",label:"), F.col("p_type")).alias("Tags"),
        F.when(k % 3 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("Amount of mapped structures"),
        k.alias("key"), F.when(k % 4 != 0, (F.col("p_size") / 2).cast("string")).otherwise("-").alias("half"), F.col("p_type").alias("WT Amino Acid"),
    )


_SAMPLES = f"""select p_brand as prot_id, aac, case when p_partkey % 5 <> 0 then p_retailprice end as target, case when p_partkey % 3 = 0 then 0 else p_size end as structures, p_partkey as key, case when p_partkey % 4 <> 0 then p_size / 2.0 end as half,
  p_type as kind, p_size::double as by_tag from (select *, {_AAC} as aac from part)"""


@query(f"select prot_id, aac, round(target, 6) as target, structures, key, half, kind from ({_SAMPLES})")
def feature_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processed table written and read, its types found by all values."""
    path = scratch(spark, "samples")
    tables.write_samples(_sample_file(spark, sf_dir), path)
    rows, _ = tables.feature_table(spark, path)
    return r6(rows.select("prot_id", "aac", "target", "structures", F.col("key").cast("long").alias("key"), "half", F.col("Wildtype AA").alias("kind")), "target")


@query(f"select prot_id, aac, structures, key, by_tag from ({_SAMPLES})")
def raw_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by ordinal; the target is a tag's number."""
    rows = _sample_file(spark, sf_dir)
    a = F.col("AAC")
    held = {1: F.col("Uniprot Ac"), 3: expr.wild_type(a), 4: expr.position(a), 5: expr.mutant(a), 6: F.col("key"), 7: F.col("Tags"), 19: F.col("Amount of mapped structures")}
    path = scratch(spark, "raw")
    tables.write_samples(rows.select(*[held.get(i, F.lit("0")).alias(f"c{i}") for i in range(20)]), path)
    read, _ = tables.feature_table(spark, path, tables.RAW, "#t")
    return read.select("prot_id", "aac", "structures", F.col("c6").cast("long").alias("key"), F.col("target").alias("by_tag"))


@query(f"select prot_id, aac, round(target, 6) as target, key from ({_SAMPLES}) where target is not null")
def support_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a support table need a target; the packed dump keeps types."""
    rows = _sample_file(spark, sf_dir).select(F.col("Uniprot Ac").alias("prot_id"), F.col("AAC").alias("aac"), expr.as_real(F.col("Target value")).alias("target"), "key")
    path = scratch(spark, "packed")
    tables.write_packed(clean.with_target(rows, "target"), path)
    return r6(tables.packed(spark, path), "target")


@query(f"select prot_id, aac, key, greatest(structures, 0) as structures from ({_SAMPLES}) where structures >= 10")
def enough_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02."""
    rows = _sample_file(spark, sf_dir).select(F.col("Uniprot Ac").alias("prot_id"), F.col("AAC").alias("aac"), "key", F.coalesce(F.col("Amount of mapped structures").try_cast("int"), F.lit(0)).alias("structures"))
    return clean.enough_structures(rows, "structures", 10)


@query("select event_id, event_id % 3 = 0 or event_id % 7 = 0 or event_id % 11 = 0 as bad from events")
def non_finite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    k = F.col("event_id")
    x = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("-inf"))).when(k % 11 == 0, None).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", clean.non_finite(x).alias("bad"))


@query("""select o_orderkey, list_aggregate(list_sort(list(l_partkey)), 'string_agg', ':') as parts, len(list(l_partkey))::int as n, round(any_value(o_totalprice), 6) as effect
  from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def variant_sets_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S07."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    sets = table(spark, sf_dir, "orders").join(lines, "o_orderkey").groupBy("o_orderkey", "o_totalprice").agg(F.array_join(F.sort_array(F.collect_list("l_partkey")).cast("array<string>"), ":").alias("aacs"))
    path = scratch(spark, "sets")
    tables.write_samples(sets.select("o_orderkey", "aacs", F.concat(F.lit("#e:"), "o_totalprice").alias("tags")), path)
    read = tables.variant_sets(spark, path, "#e")
    return r6(read.select(F.col("prot_id").cast("long").alias("o_orderkey"), F.array_join("aacs", ":").alias("parts"), F.size("aacs").alias("n"), "effect"), "effect")


@query(f"select p_partkey as key, p_brand as prot_id, aac, (p_partkey % 4)::int as fold from (select *, {_AAC} as aac from part) where p_partkey % 9 <> 0")
def split_table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S08 with X04: folds by a file of id, variant and bin."""
    rows = _variants(spark, sf_dir).select(F.concat_ws("/", "p_brand", "p_partkey").alias("prot_id"), "aac", F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    path = scratch(spark, "bins")
    rows.where("key % 9 <> 0").select("prot_id", "aac", (F.col("key") % 4).alias("bin")).write.csv(path, sep="\t")
    from variantlab.operators.splits import given_folds

    return given_folds(rows, tables.split_table(spark, path), ["prot_id", "aac"]).select("key", F.col("brand").alias("prot_id"), "aac", "fold")


@query("select c_name as name from customer where c_custkey % 3 <> 0")
def names_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names among blanks and comments."""
    path = scratch(spark, "names")
    k = F.col("c_custkey")
    table(spark, sf_dir, "customer").select(F.when(k % 6 == 0, "").when(k % 3 == 0, F.concat(F.lit("# "), "c_name")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))).write.text(path)
    return tables.names_list(spark, path)


# sequences


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the alignments as sequences: id and residues."""
    return aligned(spark, sf_dir).select((F.col("prot_id") * 1000000 + F.col("row_nr")).alias("id"), "prot_id", "row_nr", "aligned", F.replace("aligned", F.lit("-"), F.lit("")).alias("s"))


_PROTEINS = f"select prot_id * 1000000 + row_nr as id, prot_id, row_nr, aligned, replace(aligned, '-', '') as s from ({_ALIGNED})"


@query(f"select 'P' || id as prot_id, s as seq from ({_PROTEINS})")
def fasta_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads with bars, lower case, slashes and stars."""
    rows = _proteins(spark, sf_dir).select(F.concat(F.lit("db|P"), "id", F.lit("|x some words")).alias("head"), F.concat(F.lower("s"), F.lit("/*")).alias("seq"))
    path = scratch(spark, "fasta")
    sequences.write_fasta(rows, path, "head", compression="gzip")
    return sequences.fasta(spark, path)


@query(f"select 'S' || id as seq_id, aligned from ({_PROTEINS})")
def alignment_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned records of a folder's files."""
    path = scratch(spark, "aligned")
    sequences.write_fasta(_proteins(spark, sf_dir).select(F.concat(F.lit("S"), "id").alias("head"), "aligned"), path, "head", "aligned")
    return sequences.alignment(spark, path).select("seq_id", "aligned")


@query(f"select 'H' || id as hit_id, aligned as q_aln, reverse(aligned) as t_aln from ({_PROTEINS})")
def pairwise_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and hits in turn."""
    path = scratch(spark, "pairs")
    _proteins(spark, sf_dir).select(F.concat(F.lit(">Q\n"), "aligned", F.lit("\n>H"), "id", F.lit("\n"), F.reverse("aligned"))).write.text(path)
    return sequences.pairwise(spark, path).select("hit_id", "q_aln", "t_aln")


@query("select 'C' || c_custkey as prot_id, c_custkey % 97 as n from customer")
def sharded_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by ranges of the name, read back together."""
    path = scratch(spark, "shards")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("prot_id"), F.repeat(F.lit("A"), (F.col("c_custkey") % 97).cast("int")).alias("seq"))
    sequences.write_shards(rows, path, 12)
    return sequences.fasta(spark, path).select("prot_id", F.length("seq").cast("long").alias("n"))


@query("""with s as (select 'C' || c_custkey || case when c_custkey % 2 = 0 then '-1' else '' end as prot_id, c_name as seq from customer where c_custkey % 4 <> 0)
  select o_orderkey, 'C' || o_custkey || '-1' as name, coalesce(a.seq, b.seq) as seq from orders left join s a on a.prot_id = 'C' || o_custkey || '-1' left join s b on b.prot_id = 'C' || o_custkey""")
def canonical_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of an id, or failing that of the id without its isoform."""
    k = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").where(k % 4 != 0).select(F.concat(F.lit("C"), k, F.when(k % 2 == 0, "-1").otherwise("")).alias("prot_id"), F.col("c_name").alias("seq"))
    wanted = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey", F.lit("-1")).alias("name"))
    return sequences.with_canonical(wanted, known, "name").select("o_orderkey", "name", "seq")


@query(f"select id, translate(s, 'CKIS', 'UOJS') as rare, translate(translate(s, 'CKIS', 'UOJS'), 'UOJ', 'CKI') as seq from ({_PROTEINS})")
def standard_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    rare = F.translate("s", "CKI", "UOJ")
    return _proteins(spark, sf_dir).select("id", rare.alias("rare"), expr.standard_residues(rare).alias("seq"))


@query(f"""with c as (select id, unnest(string_split(aligned || lower(aligned) || '?', '')) as residue from ({_PROTEINS}))
  select id, residue, count(*) as n, max(case when length(residue) = 1 then strpos('{expr.RESIDUES}', upper(residue)) - 1 else -1 end)::int as code from c where residue <> '' group by 1, 2""")
def residue_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P29."""
    from variantlab.operators import alignment

    text = F.concat("aligned", F.lower("aligned"), F.lit("?"))
    cells = _proteins(spark, sf_dir).select("id", F.explode(F.split(text, "")).alias("residue")).where("residue <> ''")
    return alignment.residue_codes(cells, "residue", "code").groupBy("id", "residue").agg(F.count("*").alias("n"), F.max("code").alias("code"))


@query(f"select prot_id, (row_number() over (partition by prot_id order by (row_nr <> 3)::int, row_nr) - 1)::int as row_nr, aligned from ({_PROTEINS})")
def seed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another row becomes the seed."""
    from variantlab.operators import alignment

    return alignment.seed_first(_proteins(spark, sf_dir).select("prot_id", "row_nr", "aligned"), F.col("row_nr") == 3)


_PAIRS = f"""select b.prot_id, b.row_nr, b.id, list_filter(list_zip(string_split(a.aligned, ''), string_split(b.aligned, '')), lambda x: x[1] <> '-' or x[2] <> '-') as z
  from ({_PROTEINS}) b join ({_PROTEINS}) a on a.prot_id = b.prot_id and a.row_nr = 0 and b.row_nr > 0"""


@query(f"""with p as ({_PAIRS}), c as (select prot_id, row_nr, i, z[i][1] as q, z[i][2] as t from (select *, unnest(generate_series(1, len(z))) as i from p)),
  k as (select *, count(*) filter (q <> '-') over (partition by prot_id, row_nr order by i rows between unbounded preceding and current row) - (q <> '-')::int as place from c),
  m as (select prot_id, place, max(n) as n from (select prot_id, row_nr, place, count(*) as n from k where q = '-' group by all) group by all),
  r as (select prot_id, row_nr, place, coalesce(string_agg(t, '' order by i) filter (q = '-'), '') as ins, coalesce(max(t) filter (q <> '-'), '') as own from k group by all),
  e as (select prot_id, s, unnest(generate_series(0, length(s))) as place from ({_PROTEINS}) where row_nr = 0),
  g as (select e.prot_id, d.row_nr, e.place, rpad(coalesce(r.ins, ''), coalesce(m.n, 0)::int, '-') || coalesce(r.own, '') as part from e join (select distinct prot_id, row_nr from c) d on d.prot_id = e.prot_id
    left join m on m.prot_id = e.prot_id and m.place = e.place left join r on r.prot_id = e.prot_id and r.row_nr = d.row_nr and r.place = e.place),
  s as (select e.prot_id, 0 as row_nr, e.place, repeat('-', coalesce(m.n, 0)::int) || substr(s, e.place::int + 1, 1) as part from e left join m on m.prot_id = e.prot_id and m.place = e.place)
  select prot_id, row_nr::int as row_nr, string_agg(part, '' order by place) as aligned from (select * from g union all select * from s) group by all""")
def assembled_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments put together from every row's pairwise alignment with the first one."""
    from variantlab.operators import alignment

    rows = _proteins(spark, sf_dir)
    seeds = rows.where("row_nr = 0").select("prot_id", F.col("s").alias("seq"), F.split("aligned", "").alias("_seed"))
    both = F.filter(F.arrays_zip(F.col("_seed").alias("q"), F.split("aligned", "").alias("t")), lambda x: (x["q"] != "-") | (x["t"] != "-"))
    pairs = rows.where("row_nr > 0").join(seeds.select("prot_id", "_seed"), "prot_id").withColumn("z", both)
    pairs = pairs.select("prot_id", "row_nr", F.col("id").alias("hit_id"), F.array_join(F.col("z")["q"], "").alias("q_aln"), F.array_join(F.col("z")["t"], "").alias("t_aln"))
    return alignment.assembled(seeds.select("prot_id", "seq"), pairs, rank="row_nr").select("prot_id", "row_nr", "aligned")


_SELF = " + ".join(f"{row[i]} * (length(s) - length(replace(s, '{c}', '')))" for i, (c, row) in enumerate(zip(expr.RESIDUES, expr.blosum())))


@query(f"select id, s as q_aln, s as t_aln, ({_SELF})::double as score from ({_PROTEINS})")
def aligned_to_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence's alignment with itself has no gap and scores its residues' own substitutions."""
    from variantlab.operators import search

    pairs = _proteins(spark, sf_dir).select("id", F.col("s").alias("q_seq"), F.col("s").alias("t_seq"))
    return search.aligned_hits(pairs).select("id", "q_aln", "t_aln", "score")


# profiles, hits and reports

_SCORE = "round(((p_size * i) % 17 - 8) / 3.0, 3)"


@query(f"select (p_partkey)::int as pos, '{expr.RESIDUES}'[i] as aa, {_SCORE} as score from part, generate_series(1, 20) g(i)")
def profile_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's lines written and read."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("pos"), "p_size", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i"))
    score = F.round((F.pmod(F.col("p_size") * F.col("i"), F.lit(17)) - 8) / 3.0, 3)
    rows = part.select(F.lit("p").alias("prot_id"), "pos", F.substring(F.lit(expr.RESIDUES), F.col("i"), F.lit(1)).alias("aa"), score.alias("score"), F.col("p_size").cast("long").alias("n_rows"))
    path = scratch(spark, "profile")
    tables.profile_lines(rows).select("line").write.text(path)
    return tables.profile_table(spark, path, "p").select("pos", "aa", "score")


@query("select l_suppkey as query, least(count(*), 50) as n, max(length(l_shipdate::date::varchar)) as longest from lineitem group by l_suppkey")
def search_hits_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17, T07, whose feature is the number of hits."""
    path = scratch(spark, "hits")
    table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd")).write.csv(path, sep="\t")
    return tables.search_hits(spark, path, 50).groupBy(F.col("query").cast("long").alias("query")).agg(F.count("*").alias("n"), F.max(F.length("tseq")).cast("long").alias("longest"))


@query("select 'K' || p_partkey as target, p_size::int as length, p_retailprice / 1000 as evalue, replace(p_type, 'E', '') as tseq from part")
def search_reports_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of XML reports, a file each."""
    path = scratch(spark, "reports")
    parts = ("<Hit><Hit_id>gi|K", "p_partkey", "|x</Hit_id><Hit_def>d</Hit_def><Hit_len>", "p_size", "</Hit_len><Hit_hsps><Hsp><Hsp_evalue>", F.col("p_retailprice") / 1000, "</Hsp_evalue><Hsp_hseq>", F.replace("p_type", F.lit("E"), F.lit("-")), "</Hsp_hseq></Hsp></Hit_hsps></Hit>")
    hit = F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("p_") else x for x in parts])
    whole = F.concat(F.lit("<Iteration_hits>"), F.array_join(F.collect_list(hit), ""), F.lit("</Iteration_hits>")).alias("value")
    table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 100).alias("report")).agg(whole).write.partitionBy("report").text(path)
    return tables.blast_hits(spark, path).select("target", "length", "evalue", "tseq")


@query("""with r as (select o_custkey, rank() over (partition by o_custkey order by o_totalprice) + (count(*) over (partition by o_custkey, o_totalprice) - 1) / 2.0 as a, rank() over (partition by o_custkey order by o_orderkey % 1000) + (count(*) over (partition by o_custkey, o_orderkey % 1000) - 1) / 2.0 as b from orders)
  select o_custkey::varchar as "group", count(*) as n, round(case when isnan(corr(a, b)) then null else corr(a, b) end, 6) as r from r group by o_custkey""")
def predictions_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written with their errors, read back and scored by group."""
    path = scratch(spark, "predictions")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("target"), (F.col("o_orderkey") % 1000).cast("double").alias("prediction"))
    tables.write_predictions(rows.where("o_custkey % 2 = 0"), path)
    tables.write_predictions(rows.where("o_custkey % 2 <> 0"), path, first=False)
    return r6(tables.results_by_group(spark, path, "o_custkey", "target", "prediction"), "r")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def missing_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored table lacks."""
    stored = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.missing(table(spark, sf_dir, "orders").select("o_orderkey"), stored, "o_orderkey")


@query(f"select id, length(s)::bigint as n_residues, case when row_nr % 2 = 0 then 1 else 2 end as version from ({_PROTEINS})")
def stored_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store is brought up to date twice; the second time computes only what the first one lacked."""
    rows = _proteins(spark, sf_dir)
    store = Store(spark, scratch(spark, "store"), "id")
    for version, wanted in ((1, rows.where("row_nr % 2 = 0")), (2, rows)):
        store.updated(wanted, lambda new, version=version: new.select("id", F.length("s").cast("long").alias("n_residues"), F.lit(version).alias("version")))
    return store.looked_up(rows)


@query(f"""with s as (select s from ({_PROTEINS}) where prot_id = 0 and row_nr = 0), c as (select s[pos] as wt, pos, '{expr.RESIDUES}'[i] as mut, i, pos + i as k from s, generate_series(1, length(s)) p(pos), generate_series(1, 20) r(i))
  select wt || pos || mut as aac, ((i * 7 + pos * 3) % 17 - 8) / 4.0::double as value from c where k % 5 <> 0""")
def effect_matrix_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix with a row for each mutant residue and a column for each position, NA in some cells."""
    seed = _proteins(spark, sf_dir).where("prot_id = 0 and row_nr = 0").select("s")
    sequence = seed.first().s
    cell = lambda p: F.when((p + F.col("i")) % 5 == 0, "NA").otherwise(((F.pmod(F.col("i") * 7 + p * 3, F.lit(17)) - 8) / 4.0).cast("string"))
    rows = seed.select("s", F.posexplode(F.split(F.lit(expr.RESIDUES), "")).alias("i", "aa")).where("aa <> ''").withColumn("i", F.col("i") + 1)
    line = F.concat_ws(" ", F.concat(F.lit('"'), F.lower("aa"), F.lit('"')), F.transform(F.sequence(F.lit(1), F.length("s")), cell))
    path = scratch(spark, "matrix")
    rows.select(line).write.text(path)
    return tables.effect_matrix(spark, path, "p", sequence).select("aac", "value")


@query(f"select (row_number() over (order by row_nr) - 1)::int as row_nr, 'S' || row_nr as seq_id, aligned from ({_PROTEINS}) where prot_id = 1")
def block_alignment_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alignment in blocks of 60 columns, with lines of marks between."""
    rows = _proteins(spark, sf_dir).where("prot_id = 1").select("row_nr", "aligned")
    width = F.ceil(F.length("aligned") / 60).cast("int")
    parts = rows.select("row_nr", F.explode(F.sequence(F.lit(0), width - 1)).alias("block"), "aligned")
    lines = parts.select("block", "row_nr", F.format_string("S%d   %s", "row_nr", F.substring("aligned", F.col("block") * 60 + 1, F.lit(60))).alias("line"))
    marks = lines.select("block", F.lit(1 << 30).alias("row_nr"), F.lit("      **  .:").alias("line")).distinct()
    path = scratch(spark, "blocks")
    lines.union(marks).orderBy("block", "row_nr").coalesce(1).select("line").write.text(path)  # the file's order is its meaning
    return tables.block_alignment(spark, path, "p").select("row_nr", "seq_id", "aligned")


@query("select p_brand as prot_id, count(*) as weight from part group by p_brand")
def weights_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each protein, its samples, written and read."""
    path = scratch(spark, "weights")
    tables.write_samples(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("prot_id")).agg(F.count("*").alias("weight")), path)
    return tables.text_table(spark, path).select("prot_id", expr.as_real(F.col("weight")).cast("long").alias("weight"))


_FEATURES = [("p_size", "integer", "structural", 0), ("p_type", "categorical", "structural", "Not mapped"), ("p_retailprice", "real", "sequence", 2.0, True)]


@query("""select p_partkey, case when p_partkey % 4 = 0 then 0 else p_size end::bigint as p_size, case when p_partkey % 3 = 0 then 'Not mapped' else p_type end as p_type, case when p_partkey % 5 = 0 then 2.0 else p_retailprice end::double as p_retailprice from part""")
def catalogue_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values by the features' defaults."""
    some = lambda c, k: F.when(F.col("p_partkey") % k != 0, F.col(c)).alias(c)
    rows = table(spark, sf_dir, "part").select("p_partkey", some("p_size", 4), some("p_type", 3), some("p_retailprice", 5))
    return report.filled(rows, _FEATURES)


# expressions


@query("select o_orderkey, round(case when o_totalprice < 150000 then -1 when o_totalprice > 150000 then 1 else 0 end * sqrt(abs(o_totalprice - 150000)), 6) as error from orders")
def warped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    return r6(table(spark, sf_dir, "orders").select("o_orderkey", expr.warped_error(F.col("o_totalprice"), F.lit(150000.0), 0.5).alias("error")), "error")


_SHOWN = "(o_totalprice / 7.0 / case o_orderkey % 4 when 0 then 1 when 1 then 10000 when 2 then 10000000 else 100000000000 end)"


@query(f"select o_orderkey, case when {_SHOWN} >= 100 then printf('%.0f', {_SHOWN}) when {_SHOWN} >= 1 then printf('%.2f', {_SHOWN}) when {_SHOWN} >= 0.001 then printf('%.4f', {_SHOWN}) else printf('%.2e', {_SHOWN}) end as shown from orders")
def shown_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    k = F.col("o_orderkey") % 4
    x = F.col("o_totalprice") / 7.0 / F.when(k == 0, 1.0).when(k == 1, 1e4).when(k == 2, 1e7).otherwise(1e11)
    return table(spark, sf_dir, "orders").select("o_orderkey", expr.shown(x).alias("shown"))


_NAMES = ["phi", "GPW ref a", "x MSA smsa", "gemme_1", "mc long", "sc neighbor", "mc Protein", "sc ligand", "mc metal", "lig_d", "oh_structural_classification_Core", "oh_ssa_H", "oh_simple_class_ligand", "oh_simple_class_Surface", "mc_rsa_d", "b_rsa", "Sidechain location", "Closeness Centrality",
          "Volume change", "M AA_x", "oh_AA G", "Site_x", "All_atom_x", "inter_chain_n", "intra_chain_n", "oh_Function Type_a", "Function Type", "cis_n", "n_ssbond", "Protein Size", "simple_class", "b_factor", "none of them"]
_AA, _NP = "'amino acid properties'", "'non-PPI contacts'"
_CATEGORY = f"""case when n = 'phi' then 'geometric' when n in ('GPW ref a', 'x MSA smsa', 'gemme_1') then 'evolutionary' when n in ('mc long', 'sc neighbor', 'intra_chain_n') then 'intra contacts' when n in ('mc Protein', 'inter_chain_n') then 'PPI contacts'
  when n in ('sc ligand', 'mc metal', 'lig_d', 'oh_simple_class_ligand') then {_NP} when n in ('oh_structural_classification_Core', 'mc_rsa_d', 'b_rsa', 'Sidechain location') then 'solvent access' when n = 'oh_ssa_H' or n in ('cis_n', 'n_ssbond') then 'geometric'
  when n = 'Closeness Centrality' then 'RIN centrality' when n in ('Volume change', 'M AA_x', 'oh_AA G') then {_AA} when n in ('Site_x', 'All_atom_x') then 'structural conservation' when n in ('oh_Function Type_a', 'Function Type') then 'function type'
  when n = 'Protein Size' then 'protein attributes' when n = 'simple_class' then 'structural classification' when n = 'b_factor' then 'flexibility' end"""
_SUB = """case when n in ('phi', 'mc long', 'sc neighbor', 'intra_chain_n', 'oh_ssa_H', 'b_rsa', 'Sidechain location', 'cis_n', 'n_ssbond', 'b_factor') then 'Tertiary' when n in ('mc Protein', 'sc ligand', 'mc metal', 'lig_d', 'inter_chain_n') then 'Interaction'
  when n in ('Site_x', 'All_atom_x') then 'Structural conservation' when n in ('oh_structural_classification_Core', 'oh_simple_class_ligand', 'mc_rsa_d', 'Closeness Centrality', 'simple_class') then 'Aggregation' end"""
_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query(f"with f as (select p_partkey, {_NAME_LIST}[(p_partkey % {len(_NAMES)})::int + 1] as n from part) select p_partkey, n as name, {_CATEGORY} as category, {_SUB} as sub_category from f")
def feature_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, P30."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("*", expr.feature_category(F.col("name")).alias("category"), expr.feature_sub_category(F.col("name")).alias("sub_category"))


_MATRIX = ", ".join(f"('{a}', '{b}', {v})" for a, row in zip(expr.RESIDUES, expr.blosum()) for b, v in zip(expr.RESIDUES, row))
_PAIR = "substr('ARNDCQEGHILKMFPSTWYVX', (p_partkey % 21)::int + 1, 1) as a, substr('ARNDCQEGHILKMFPSTWYVX', (p_partkey // 21 % 21)::int + 1, 1) as b"


@query(f"with m(a, b, v) as (values {_MATRIX}), p as (select p_partkey, {_PAIR} from part) select p_partkey, a, b, v::int as score from p left join m using (a, b)")
def substitution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL where one residue isn't standard."""
    return _pairs(spark, sf_dir).select("p_partkey", "a", "b", expr.substitution(F.col("a"), F.col("b")).cast("int").alias("score"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda i: F.substring(F.lit(expr.RESIDUES + "X"), i.cast("int") + 1, F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", letter(F.col("p_partkey") % 21).alias("a"), letter(F.floor(F.col("p_partkey") / 21) % 21).alias("b"))


def _values(table_: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in table_.items())


_KEPT = ", ".join(f"(strpos('{m}', a) > 0) = (strpos('{m}', b) > 0) as {n}_kept" for n, m in expr.RESIDUE_CLASSES.items())


@query(f"""with h(x, h) as (values {_values(expr.HYDROPATHY)}), v(x, v) as (values {_values(expr.VOLUME)}), p as (select p_partkey, {_PAIR} from part)
  select p_partkey, round(hb.h - ha.h, 6)::double as hydropathy_change, round(vb.v - va.v, 6)::double as volume_change, {_KEPT} from p join h ha on ha.x = a join h hb on hb.x = b join v va on va.x = a join v vb on vb.x = b""")
def residue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23."""
    found = expr.residue_change(F.col("a"), F.col("b"))
    return r6(_pairs(spark, sf_dir).select("p_partkey", *[c.alias(k) for k, c in found.items()]), "hydropathy_change", "volume_change")


@query("""select l_orderkey, l_linenumber, round((1 + l_discount) ** 2 - abs(l_tax - l_discount), 6) as gap, round(l_discount - 12 * 0.001 - ln(greatest(1.0, l_extendedprice / 3600)) * 0.001, 6) as cost from lineitem""")
def score_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25."""
    d = F.col("l_discount")
    return r6(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", expr.gap_penalty(F.col("l_tax"), d).alias("gap"), expr.cost_penalty(d, F.lit(12), 0.001, F.col("l_extendedprice")).alias("cost")), "gap", "cost")


@query("select p_partkey, translate(p_brand || '/(' || p_type || '),' || p_size || '-2', '/,()', '____') as name, p_brand || '/(' || p_type || '),' || p_size as own from part")
def clean_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27."""
    name = F.concat("p_brand", F.lit("/("), "p_type", F.lit("),"), "p_size", F.lit("-2"))
    return table(spark, sf_dir, "part").select("p_partkey", expr.clean_id(name).alias("name"), expr.canonical(name).alias("own"))


@query("select event_id, list_aggregate([coalesce(value::varchar, '?'), case when event_id % 2 = 0 then '1.0' else '?' end, '0.0', '?'], 'string_agg', ',') as cells from (select event_id, case when event_id % 5 <> 0 then round(value, 1) end as value from events)")
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns in order; an unknown `oh_` column is 0, another NULL."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.round("value", 1)).alias("x"), F.when(F.col("event_id") % 2 == 0, 1).alias("oh_kind_a"))
    out = encode.matrix(rows, ["event_id"], ["x", "oh_kind_a", "oh_kind_b", "y"])
    return out.select("event_id", F.array_join(F.transform("features", lambda v: F.coalesce(v.cast("string"), F.lit("?"))), ",").alias("cells"))
