"""Checks of résumé structuring, on résumés rendered from customers, suppliers and parts."""

from pyspark.sql import functions as F

from docrecords.operators import canonical, resume
from docrecords.plans.stages import stage

from . import q_structure
from . import views as V

QUERIES = {}
ORACLE = {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@V.view
def resume_texts(spark, sf):
    """One text per customer; those of every fifth customer have no résumé sections."""
    k = F.col("c_custkey")
    key = k.cast("string")
    letter = F.element_at(F.array(*[F.lit(x) for x in ("Ada", "Bela", "Chris", "Dana")]), (k % 4 + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(x) for x in ("Lovelace", "Noether", "Turing")]), (k % 3 + 1).cast("int"))
    has = k % 5 != 0
    parts = [
        F.concat(letter, F.lit(" "), other),
        F.concat(F.lit("Berlin, person"), key, F.lit("@example.org, +49 170 55"), F.lpad(key, 5, "0")),
        F.when(has, F.lit("SUMMARY\nbuilder of careful things and plain words.")),
        F.when(has, F.lit("Work Experience")),
        F.when(has, F.concat(F.lit("Acme "), F.initcap("c_mktsegment"), F.lit(", Berlin"))),
        F.when(has, F.concat(F.lit("Software Engineer Jan "), (k % 20 + 2000).cast("string"), F.lit(" - Present"))),
        F.when(has, F.concat(F.lit("- built the "), F.lower("c_mktsegment"), F.lit(" platform\n- led reviews of "), key, F.lit(" records"))),
        F.when(has & (k % 2 == 0), F.lit("Data Analyst 2010 - 2012\n- reduced the cost of reports")),
        F.when(has, F.lit("Education\nTechnical University 2001 - 2005\nMSc in careful engineering of data.")),
        F.when(has & (k % 3 == 0), F.lit("Skills\nLanguages: Python, Scala\nTools: Spark")),
        F.when(has & (k % 3 == 1), F.lit("Skills\nplain skills in a sentence of words.")),
        F.when(has & (k % 2 == 1), F.lit("Projects\nGlobe Atlas\n- a map of the world for readers")),
        F.when(has, F.lit("Awards\n- Recipient of the Great Prize\nfor work on maps.\n- Won a scholarship.")),
    ]
    return V.table(spark, sf, "customer").select(k.alias("doc_id"), F.concat_ws("\n", *parts).alias("text"))


@V.view
def lines(spark, sf):
    return stage(canonical.structure_lines(resume_texts(spark, sf)), "resume-lines")


def sections(spark, sf):
    return resume.resume_sections(canonical.blocks(lines(spark, sf)))


SECTION_SQL = """SELECT c_custkey AS doc_id, unnest(['summary','experience','education','skills','projects','achievements']) AS section_kind,
   unnest([1, 2, 3, CASE WHEN c_custkey % 3 < 2 THEN 4 END, CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 3 < 2 THEN 5 ELSE 4 END END,
     4 + CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 0 END]) AS section_index FROM customer WHERE c_custkey % 5 <> 0"""


@check("x19_resume_sections", f"SELECT doc_id, section_kind, section_index::BIGINT AS section_index FROM ({SECTION_SQL}) WHERE section_index IS NOT NULL")
def _(spark, sf):
    return sections(spark, sf).filter("is_title").select("doc_id", "section_kind", F.col("section_index").cast("bigint").alias("section_index"))


@check("x20_resume_documents", "SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, sf):
    return resume.resume_documents(sections(spark, sf), resume_texts(spark, sf))


@check(
    "x21_candidate_name",
    "SELECT c_custkey AS doc_id, (['Ada','Bela','Chris','Dana'])[c_custkey % 4 + 1] || ' ' || (['Lovelace','Noether','Turing'])[c_custkey % 3 + 1] AS value FROM customer",
)
def _(spark, sf):
    return resume.candidate_name(sections(spark, sf)).select("doc_id", "value")


@check(
    "x22_date_ranges",
    """SELECT o_orderkey, trim(regexp_replace(a || ' ' || b, '\\s{2,}', ' ', 'g')) AS text, p AS period FROM (SELECT o_orderkey, o_orderpriority AS a, 'Team ' || o_custkey AS b,
      CASE o_orderkey % 3 WHEN 0 THEN 'Mar 19' || lpad((o_orderkey % 90 + 10)::VARCHAR, 2, '0') || ' – Present' WHEN 1 THEN '2001 to Sept. 2004' END AS p FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    p = F.when(k % 3 == 0, F.concat(F.lit("Mar 19"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit(" – Present"))).when(k % 3 == 1, F.lit("2001 to Sept. 2004"))
    raw = F.concat_ws(" ", "o_orderpriority", p, F.concat(F.lit("Team "), F.col("o_custkey").cast("string")))
    text, period = resume.strip_period(F.col("raw"))
    return V.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", text.alias("text"), period.alias("period"))


_CONTACT = "'Berlin, person' || k || '@example.org, +49 170 55' || lpad(k::VARCHAR, 5, '0')"
ROWS_SQL = f"""
WITH c AS (SELECT c_custkey AS k, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS seg, lower(c_mktsegment) AS low FROM customer WHERE c_custkey % 5 <> 0)
SELECT k AS doc_id, array_key, row_index, column_key, value FROM (
  SELECT k, NULL AS array_key, NULL::INT AS row_index, 'candidateName' AS column_key, (['Ada','Bela','Chris','Dana'])[k % 4 + 1] || ' ' || (['Lovelace','Noether','Turing'])[k % 3 + 1] AS value FROM c
  UNION ALL SELECT k, NULL, NULL, 'email', 'person' || k || '@example.org' FROM c
  UNION ALL SELECT k, NULL, NULL, 'phone', regexp_extract({_CONTACT}, '{q_structure._PH}') FROM c
  UNION ALL SELECT k, NULL, NULL, 'summary', 'builder of careful things and plain words.' FROM c
  UNION ALL SELECT k, 'experience', 0, 'organization', 'Acme ' || seg || ', Berlin' FROM c
  UNION ALL SELECT k, 'experience', 0, 'role', 'Software Engineer' FROM c
  UNION ALL SELECT k, 'experience', 0, 'period', 'Jan ' || (k % 20 + 2000) || ' - Present' FROM c
  UNION ALL SELECT k, 'experience', 0, 'description', 'built the ' || low || ' platform' || chr(10) || 'led reviews of ' || k || ' records' FROM c
  UNION ALL SELECT k, 'experience', 1, 'organization', 'Acme ' || seg || ', Berlin' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'experience', 1, 'role', 'Data Analyst' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'experience', 1, 'period', '2010 - 2012' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'experience', 1, 'description', 'reduced the cost of reports' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'education', 0, 'institution', 'Technical University' FROM c
  UNION ALL SELECT k, 'education', 0, 'period', '2001 - 2005' FROM c
  UNION ALL SELECT k, 'education', 0, 'credential', 'MSc in careful engineering of data.' FROM c
  UNION ALL SELECT k, 'skills', i - 1, 'category', (['Languages','Tools'])[i] FROM c, (SELECT unnest([1, 2]) AS i) WHERE k % 3 = 0
  UNION ALL SELECT k, 'skills', i - 1, 'text', (['Python, Scala','Spark'])[i] FROM c, (SELECT unnest([1, 2]) AS i) WHERE k % 3 = 0
  UNION ALL SELECT k, 'skills', 0, 'category', 'Skills' FROM c WHERE k % 3 = 1
  UNION ALL SELECT k, 'skills', 0, 'text', 'plain skills in a sentence of words.' FROM c WHERE k % 3 = 1
  UNION ALL SELECT k, 'projects', 0, 'name', 'Globe Atlas' FROM c WHERE k % 2 = 1
  UNION ALL SELECT k, 'projects', 0, 'description', 'a map of the world for readers' FROM c WHERE k % 2 = 1
  UNION ALL SELECT k, 'achievements', 0, 'text', 'Recipient of the Great Prize for work on maps.' FROM c
  UNION ALL SELECT k, 'achievements', 1, 'text', 'Won a scholarship.' FROM c)"""


@check("x23_resume_rows", ROWS_SQL)
def _(spark, sf):
    rows = resume.resume_rows(resume_texts(spark, sf), lines(spark, sf))
    return rows.select("doc_id", "array_key", "row_index", "column_key", "value")
