"""Reading profile records: JSON lines or arrays, plain or gzip, with a strict check of required keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

KINDS = {"s": StringType(), "d": DoubleType(), "i": IntegerType(), "b": BooleanType()}


def _struct(kind: str, names: str) -> list[StructField]:
    return [StructField(n, KINDS[kind]) for n in names.split()]


PROFILE = StructType([*_struct("s", "anonymized_name headline summary location country"), *_struct("d", "years_of_experience"), *_struct("s", "current_title current_company current_company_size current_industry")])
ROLE = StructType([*_struct("s", "company title start_date end_date"), *_struct("i", "duration_months"), *_struct("b", "is_current"), *_struct("s", "industry company_size description")])
EDUCATION = StructType([*_struct("s", "institution degree field_of_study"), *_struct("i", "start_year end_year"), *_struct("s", "grade tier")])
SKILL = StructType([*_struct("s", "name proficiency"), *_struct("i", "endorsements duration_months")])
CERTIFICATE = StructType([*_struct("s", "name issuer"), *_struct("i", "year")])
LANGUAGE = StructType(_struct("s", "language proficiency"))
SIGNALS = StructType([
    *_struct("d", "profile_completeness_score"), *_struct("s", "signup_date last_active_date"), *_struct("b", "open_to_work_flag"),
    *_struct("i", "profile_views_received_30d applications_submitted_30d"), *_struct("d", "recruiter_response_rate avg_response_time_hours"),
    StructField("skill_assessment_scores", MapType(StringType(), DoubleType())), *_struct("i", "connection_count endorsements_received notice_period_days"),
    StructField("expected_salary_range_inr_lpa", StructType(_struct("d", "min max"))), *_struct("s", "preferred_work_mode"), *_struct("b", "willing_to_relocate"),
    *_struct("d", "github_activity_score"), *_struct("i", "search_appearance_30d saved_by_recruiters_30d"), *_struct("d", "interview_completion_rate offer_acceptance_rate"),
    *_struct("b", "verified_email verified_phone linkedin_connected"),
])
#: The field of the engagement signals in our tables; files may have it under another name.
SIGNALS_KEY = "signals"


def record_type(signals_key: str = SIGNALS_KEY) -> StructType:
    return StructType([StructField("candidate_id", StringType()), StructField("profile", PROFILE), StructField("career_history", ArrayType(ROLE)), StructField("education", ArrayType(EDUCATION)), StructField("skills", ArrayType(SKILL)), StructField("certifications", ArrayType(CERTIFICATE)), StructField("languages", ArrayType(LANGUAGE)), StructField(signals_key, SIGNALS)])


RECORD = record_type()
OPTIONAL = {"certifications", "languages", "grade", "tier"}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One column `raw`: each line that isn't blank. Names that end in .gz are decompressed."""
    return spark.read.text(path).select(F.col("value").alias("raw")).where(F.trim("raw") != "")


def missing_keys(signals_key: str = SIGNALS_KEY) -> Column:
    """Names of required keys that `raw` lacks; a key that holds null is there."""

    def lacks(json: Column, struct: StructType, where: str, optional: set[str]) -> Column:
        keys = F.coalesce(F.json_object_keys(json), F.array())
        need = [f.name for f in struct if f.name not in optional]
        return F.transform(F.array_except(F.array(*map(F.lit, need)), keys), lambda k: F.concat(F.lit(where), k))

    def each(items: Column, struct: StructType, where: str, optional: set[str]) -> Column:
        return F.flatten(F.transform(items, lambda x: lacks(x, struct, where, optional)))

    raw = F.col("raw")
    some = F.array().cast("array<string>")
    parts = [lacks(raw, record_type(signals_key), "", OPTIONAL)]
    for name, struct in (("profile", PROFILE), (signals_key, SIGNALS)):
        inner = F.get_json_object(raw, f"$.{name}")
        parts.append(F.when(inner.isNotNull(), lacks(inner, struct, f"{name}.", OPTIONAL)).otherwise(some))
    for name, struct, free in (("career_history", ROLE, OPTIONAL), ("education", EDUCATION, OPTIONAL), ("skills", SKILL, OPTIONAL | {"duration_months"}), ("certifications", CERTIFICATE, OPTIONAL), ("languages", LANGUAGE, OPTIONAL)):
        items = F.coalesce(F.from_json(F.get_json_object(raw, f"$.{name}"), "array<string>"), some)
        parts.append(each(items, struct, f"{name}[].", free))
    return F.array_distinct(F.concat(*parts))


def parse_records(raw: DataFrame, strict: bool = True, signals_key: str = SIGNALS_KEY) -> DataFrame:
    """Typed records. A malformed line, or with `strict` one that lacks a required key, ends the job with an error that names it."""
    kind = record_type(signals_key)
    rec = F.from_json("raw", kind, {"mode": "FAILFAST"})
    if strict:
        lacking = missing_keys(signals_key)
        message = F.concat(F.lit("record "), F.coalesce(F.get_json_object("raw", "$.candidate_id"), F.lit("?")), F.lit(" lacks "), F.array_join(lacking, ", "))
        rec = F.when(F.size(lacking) == 0, rec).otherwise(F.raise_error(message).cast(kind))
    x = raw.select("raw", rec.alias("r")).select("raw", "r.*").withColumnRenamed(signals_key, SIGNALS_KEY)
    for c in ("career_history", "education", "skills", "certifications", "languages"):
        x = x.withColumn(c, F.coalesce(c, F.array().cast(RECORD[c].dataType)))
    return x


def read_records(spark: SparkSession, path: str, limit: int | None = None, strict: bool = True, signals_key: str = SIGNALS_KEY) -> DataFrame:
    """Typed records of a JSON lines file or folder; the signals come under `signals_key` and go to `signals`."""
    raw = read_raw(spark, path)
    return parse_records(raw if limit is None else raw.limit(limit), strict, signals_key)


def read_any(spark: SparkSession, path: str, signals_key: str = SIGNALS_KEY) -> DataFrame:
    """Records of a JSON array or of JSON lines, by the first character."""
    first = read_raw(spark, path).select(F.substring(F.ltrim("raw"), 1, 1)).first()
    if first and first[0] == "[":
        return spark.read.schema(record_type(signals_key)).option("multiLine", True).json(path).withColumnRenamed(signals_key, SIGNALS_KEY)
    return spark.read.schema(record_type(signals_key)).option("mode", "FAILFAST").json(path).withColumnRenamed(signals_key, SIGNALS_KEY)


def by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is among `ids`."""
    return records.join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi")


def minimal(records: DataFrame) -> DataFrame:
    """Only what texts are made of."""
    return records.select("candidate_id", F.struct(*[f"profile.{c}" for c in ("headline", "summary", "current_title", "current_company")]).alias("profile"), F.transform("career_history", lambda r: F.struct(*[r[c].alias(c) for c in ("title", "company", "description")])).alias("career_history"), F.transform("skills", lambda s: F.struct(s["name"].alias("name"), s["proficiency"].alias("proficiency"))).alias("skills"))
