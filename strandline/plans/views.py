"""Genomic tables derived from the driver's, as expressions that read alike in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READ_LENGTH = "(cast(l_quantity as int) + case l_returnflag when 'A' then 0 when 'N' then 10 else 15 + l_linenumber end)"

# name: (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "alignments": (
        "lineitem",
        {
            "name": "concat('r', cast(l_orderkey as string))",
            "flags": "cast((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 4096 as int)",
            "ref_id": "case when l_suppkey % 10 = 9 then null else cast(l_suppkey % 5 as int) end",
            "pos": "case when l_suppkey % 10 = 9 then null else 1 + l_orderkey % 5000 end",
            "mapq": "case when l_partkey % 256 = 255 then null else cast(l_partkey % 256 as int) end",
            "rg": "concat(l_returnflag, l_linestatus)",
            "mate_ref_id": "cast(l_partkey % 5 as int)",
            "mate_pos": "1 + l_partkey % 5000",
            "tlen": "cast(l_linenumber * 10 - 30 as int)",
            "nh": "cast(1 + l_partkey % 3 as int)",
            "cigar": "case l_returnflag when 'A' then concat(cast(cast(l_quantity as int) as string), 'M')"
            " when 'N' then concat(cast(cast(l_quantity as int) as string), 'M', cast(l_linenumber as string), 'D10M')"
            " else concat('5S', cast(cast(l_quantity as int) as string), 'M', cast(l_linenumber as string), 'I10=') end",
            "sequence": f"substr(repeat('ACGTRYNTGCA', 12), cast(1 + l_partkey % 8 as int), {_READ_LENGTH})",
            "quality": f"substr(repeat('IHGFEDCBA@', 12), cast(1 + l_suppkey % 9 as int), {_READ_LENGTH})",
        },
    ),
    "variants": (
        "orders",
        {
            "chrom": "concat('chr', cast(1 + o_custkey % 22 as string))",
            "pos": "1 + o_orderkey % 10000",
            "id": "case when o_orderkey % 7 = 0 then '.' when o_orderkey % 7 = 1 then concat('rs', cast(o_orderkey as string), ';x', cast(o_custkey as string)) else concat('rs', cast(o_orderkey as string)) end",
            "ref": "substr('ACGTACGT', cast(1 + o_orderkey % 4 as int), cast(1 + o_custkey % 3 as int))",
            "alt": "case when o_orderkey % 11 = 0 then '.' when o_orderkey % 5 = 0 then 'A,T' else substr('TGCA', cast(1 + o_orderkey % 4 as int), 1) end",
            "qual": "case when o_orderkey % 13 = 0 then '.' else cast(o_orderkey % 100 as string) end",
            "filter": "case o_orderstatus when 'F' then 'PASS' when 'O' then 'q10;s50' else '.' end",
            "info": "concat('DP=', cast(o_custkey % 100 as string), case when o_orderkey % 3 = 0 then concat(';END=', cast(1 + o_orderkey % 10000 + o_custkey % 50 as string)) else '' end,"
            " case when o_orderkey % 4 = 0 then ';DB' else '' end, case when o_orderkey % 6 = 0 then concat(';SVLEN=', cast(o_custkey % 40 as string), ',.') else '' end, ';DP=7')",
            "gt": "case cast(o_orderkey % 5 as int) when 0 then '0/1' when 1 then '1|1' when 2 then './.' when 3 then '0' else '1|0' end",
            "sample_dp": "case when o_orderkey % 8 = 0 then null when o_orderkey % 8 = 1 then '.' else cast(o_custkey % 60 as string) end",
        },
    ),
    "features": (
        "part",
        {
            "seqid": "concat('chr', cast(1 + p_partkey % 5 as string))",
            "type": "case when p_size > 25 then 'gene' else 'exon' end",
            "start_": "1 + p_partkey * 3",
            "end_": "1 + p_partkey * 3 + p_size",
            "score": "case when p_size % 4 = 0 then '.' else cast(p_size as string) end",
            "strand": "case cast(p_partkey % 4 as int) when 0 then '+' when 1 then '-' when 2 then '.' else '?' end",
            "phase": "case when p_size > 25 then '.' else cast(p_size % 3 as string) end",
            "attributes": "concat('ID=p', cast(p_partkey as string), ';Name=', replace(p_name, ' ', '%20'), ';Dbxref=a:', cast(p_size as string), ',b+', cast(p_size as string), ';ID=late')",
            "gtf": "concat('gene_id \"g', cast(p_partkey % 100 as string), '\"; db_xref \"a:', cast(p_size as string), '\"; transcript_id \"\"; db_xref \"b:', cast(p_partkey as string), '\"; level ', cast(p_size % 3 as string), ';')",
        },
    ),
    "bed": (
        "events",
        {
            "chrom": "event_type",
            "start_": "1 + event_id % 10000",
            "end_": "event_id % 10000 + user_id % 50",
            "name": "case when user_id % 6 = 0 then '.' else concat('u', cast(user_id as string)) end",
            "score": "cast(event_id % 1001 as int)",
            "strand": "case cast(event_id % 3 as int) when 0 then '+' when 1 then '-' else '.' end",
        },
    ),
    "reads": (
        "documents",
        {
            "name": "concat('d', cast(doc_id as string))",
            "description": "source",
            "sequence": "translate(upper(regexp_replace(text, '[^A-Za-z]', '')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC')",
            "quality": "substr(repeat('IIHGF#@5', cast(floor(length(text) / 8) as int) + 1), 1, cast(length(regexp_replace(text, '[^A-Za-z]', '')) as int))",
        },
    ),
}

#: Reference sequences of the alignments.
REFERENCES = [(i, f"sq{i}", 5000 + 100 * i) for i in range(5)]

_REFERENCES_SQL = " UNION ALL ".join(f"SELECT {i} AS ref_id, '{name}' AS ref_name, CAST({n} AS BIGINT) AS ref_length" for i, name, n in REFERENCES)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[F.expr(e).alias(c) for c, e in columns.items()])


def references(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCES, "ref_id int, ref_name string, ref_length bigint")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))


def sql(*names: str) -> str:
    """The views as common table expressions for DuckDB, to begin a query with."""
    parts = []
    for name in names:
        if name == "refs":
            parts.append(f"refs AS ({_REFERENCES_SQL})")
        elif name == "text_lines":
            parts.append(
                "text_lines AS (SELECT doc_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS line_no, unnest(l) AS value"
                " FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
            )
        else:
            table, columns = VIEWS[name]
            body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
            body = body.replace("'[^A-Za-z]', '')", "'[^A-Za-z]', '', 'g')")
            parts.append(f"{name} AS (SELECT {body} FROM {table})")
    return "WITH " + ", ".join(parts) + " "


#: DuckDB expressions over an alignment's CIGAR.
SPAN_SQL = r"list_sum(regexp_extract_all(cigar, '(\d+)[MDN=X]', 1)::BIGINT[])::BIGINT"
READ_LENGTH_SQL = r"list_sum(regexp_extract_all(cigar, '(\d+)[MIS=X]', 1)::BIGINT[])::BIGINT"
