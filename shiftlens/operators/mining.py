"""Anomalies, rules and labels mined from changes and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.exprs import parent_object
from shiftlens.operators.diff import BREAKING
from shiftlens.operators.rollups import sums

# Keywords, label and confidence of personal data, the first group that fits a column's name.
PII = [
    (["EMAIL", "E_MAIL", "EMAILADDRESS", "EMAIL_ADDRESS", "EMAIL_ADDR"], "EMAIL", 0.95),
    (["SSN", "SOCIAL_SECURITY", "SOCIAL_INS", "NATIONAL_ID", "NATL_ID", "TAX_ID", "TAXPAYER_ID", "TFN", "TAXPAYER"], "SSN", 0.97),
    (["DOB", "DATE_OF_BIRTH", "BIRTHDATE", "BIRTHDAY", "BIRTH_DATE", "DATEOFBIRTH", "BIRTH_DT"], "DOB", 0.97),
    (["PHONENO", "PHONE_NO", "PHONE_NUM", "PHONENUM", "MOBILE", "CELLPHONE", "CELL_PHONE", "TELEPHONE", "TEL_NO", "TELNO", "PHONE"], "PHONE", 0.90),
    (["STREETADDRESS", "STREET_ADDRESS", "STREETADDR", "STREET_ADDR", "ZIPCODE", "ZIP_CODE", "POSTALCODE", "POSTAL_CODE", "POSTCODE", "ADDRESS", "ADDR"], "ADDRESS", 0.85),
    (["FIRSTNAME", "FIRST_NAME", "LASTNAME", "LAST_NAME", "FULLNAME", "FULL_NAME", "SURNAME", "GIVENNAME", "GIVEN_NAME", "MIDDLENAME", "MIDDLE_NAME", "CUSTOMER_NAME", "CUST_NAME", "PATIENT_NAME", "EMPLOYEE_NAME", "PERSON_NAME", "CONTACT_NAME", "DISPLAY_NAME"], "NAME", 0.92),
    (["CREDITCARD", "CREDIT_CARD", "CARDNUMBER", "CARD_NUMBER", "CARDNUM", "CARD_NUM", "CVV", "CVC", "IBAN", "ACCOUNTNUMBER", "ACCOUNT_NUMBER", "ACCT_NO", "ACCTNO", "BANKACCOUNT", "BANK_ACCOUNT", "SALARY", "INCOME", "WAGES", "WAGE", "COMPENSATION", "PAYRATE", "PAY_RATE"], "FINANCIAL", 0.88),
    (["PATIENT_ID", "PATIENTID", "CUSTOMER_ID", "CUSTOMERID", "CUST_ID", "EMPLOYEE_ID", "EMPLOYEEID", "EMP_ID", "USER_ID", "USERID", "MEMBER_ID", "MEMBERID", "PERSON_ID", "PERSONID", "INDIVIDUAL_ID", "INDIV_ID"], "ID_NUMBER", 0.85),
]


def change_anomalies(changes: DataFrame, snapshots: DataFrame, z: float = 2.0, min_baseline: int = 3) -> DataFrame:
    """(schema_name, snapshot_to, n, z, severity): counts far from the schema's other snapshots. The mean and population deviation
    leave the snapshot itself out, by sums of n and n²; whether the others are all alike is told in whole numbers."""
    dom = F.col("schema_name")
    counted = sums(changes, "schema_name", "snapshot_to").select(F.when(dom == "", "(unknown)").otherwise(dom).alias("schema_name"), "snapshot_to", F.col("n_changes").alias("n"))
    grid = counted.select("schema_name").distinct().crossJoin(F.broadcast(snapshots.select(F.col("snapshot_id").alias("snapshot_to")).distinct()))
    cells = grid.join(counted, ["schema_name", "snapshot_to"], "left").na.fill(0, ["n"])
    by = Window.partitionBy("schema_name")
    cells = cells.withColumns({"m": F.count("*").over(by) - 1, "s": F.sum("n").over(by) - F.col("n"), "q": F.sum(F.col("n") * F.col("n")).over(by) - F.col("n") * F.col("n")})
    spread = F.col("m") * F.col("q") - F.col("s") * F.col("s")  # m² times the variance
    score = F.when(spread > 0, (F.col("n") * F.col("m") - F.col("s")) / F.sqrt(spread.cast("double"))).when(F.col("n") * F.col("m") > F.col("s"), 3.0).when(F.col("n") * F.col("m") < F.col("s"), -3.0)
    found = cells.where(F.col("m") >= min_baseline).withColumn("z", F.round(score, 4)).where(F.abs("z") >= z)
    return found.select("schema_name", "snapshot_to", "n", "z", F.when(F.abs("z") >= 3, "HIGH").when(F.abs("z") >= 2, "MEDIUM").otherwise("LOW").alias("severity")).orderBy(F.desc(F.abs("z")), "schema_name", "snapshot_to")


def cochange_rules(changes: DataFrame, min_support: int = 2, min_lift: float = 1.5, top_n: int = 50, history: int = 20, max_basket: int = 500) -> DataFrame:
    """Objects that change together. A basket is a (from, to) pair of the newest `history`, if it has at most max_basket raw changes
    (the rule's own definition of a basket) and two or more objects. Of each pair the direction of higher confidence is given."""
    recent = changes.groupBy("snapshot_from", "snapshot_to").agg(F.count("*").alias("_n")).orderBy(F.desc("snapshot_to"), F.desc("snapshot_from")).limit(history).where(F.col("_n") <= max_basket)
    items = changes.join(F.broadcast(recent), ["snapshot_from", "snapshot_to"]).select("snapshot_from", "snapshot_to", parent_object("object_identifier", "object_type").alias("item")).distinct()
    size = items.groupBy("snapshot_from", "snapshot_to").agg(F.count("*").alias("_k")).where("_k >= 2").drop("_k")
    items = items.join(F.broadcast(size), ["snapshot_from", "snapshot_to"])
    alone, baskets = items.groupBy("item").agg(F.count("*").alias("n")), size.agg(F.count("*").alias("baskets"))
    pairs = items.withColumnRenamed("item", "a").join(items.withColumnRenamed("item", "b"), ["snapshot_from", "snapshot_to"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    out = pairs.join(alone.toDF("a", "na"), "a").join(alone.toDF("b", "nb"), "b").join(F.broadcast(baskets))
    forward = F.col("na") <= F.col("nb")
    out = out.select(
        F.when(forward, F.col("a")).otherwise(F.col("b")).alias("antecedent"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("consequent"), "support",
        F.round(F.col("support") / F.least("na", "nb"), 4).alias("confidence"), F.round(F.col("support") * F.col("baskets") / (F.col("na") * F.col("nb")), 4).alias("lift"),
    )
    return out.where(F.col("lift") >= min_lift).orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(top_n)


def pii_classify(columns: DataFrame, force: bool = False, budget: int | None = None, key: tuple[str, ...] = ("schema_name", "table_name", "column_name")) -> DataFrame:
    """columns(column_name[, pii_label]) with pii_label and pii_confidence by the first keyword group in the name; those that have
    a label keep it unless forced. With a budget only so many columns are classified, the first ones by `key`, which tells them apart; the
    others that have no label stay without one, for the next run."""
    if budget is not None:
        named = columns if "pii_label" in columns.columns else columns.withColumns({"pii_label": F.lit(None).cast("string"), "pii_confidence": F.lit(None).cast("double")})
        todo = F.lit(True) if force else F.col("pii_label").isNull()
        chosen = named.where(todo).select(*key).orderBy(*key).limit(budget).withColumn("_chosen", F.lit(True))
        both = named.join(chosen, list(key), "left")
        done = pii_classify(both.where("_chosen"), force)
        return done.unionByName(both.where("_chosen is null")).drop("_chosen")
    upper = F.upper("column_name")
    label, sure = F, F
    for words, name, confidence in PII:
        hit = upper.rlike("|".join(words))
        label, sure = label.when(hit, F.lit(name)), sure.when(hit, F.lit(confidence))
    label, sure = label.otherwise("NONE"), sure.otherwise(0.85)
    if "pii_label" in columns.columns and not force:
        sure = F.when(F.col("pii_label").isNotNull(), F.col("pii_confidence")).otherwise(sure)
        label = F.coalesce("pii_label", label)
    return columns.withColumns({"pii_label": label, "pii_confidence": sure})


def change_risk(changes: DataFrame) -> DataFrame:
    """changes(change_type, n_impacts) with risk: breaking with over two impacts HIGH, breaking MEDIUM, else LOW."""
    breaking = F.col("change_type").isin(BREAKING)
    return changes.withColumn("risk", F.when(breaking & (F.col("n_impacts") > 2), "HIGH").when(breaking, "MEDIUM").otherwise("LOW"))


def alerts_feed(changes: DataFrame, structural: DataFrame, limit: int = 50) -> DataFrame:
    """Breaking or HIGH changes, newest first, after the latest structural alerts (alert_type, severity, subject)."""
    own = changes.where("is_breaking or severity = 'HIGH'").orderBy(F.desc("detected_at"), F.desc("change_id")).limit(limit)
    own = own.select(F.when(F.col("is_breaking"), "BREAKING_CHANGE").otherwise("HIGH_SEVERITY").alias("alert_type"), F.lit("HIGH").alias("severity"), F.col("change_id").cast("string").alias("subject"))
    return own.unionByName(structural.select("alert_type", "severity", "subject"))
