"""People, teams, applications, and search over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.exprs import schema_of


def usage_by_team(usage: DataFrame, people: DataFrame, teams: DataFrame, departments: DataFrame) -> DataFrame:
    """Queries, usage rows and distinct users by team and department; users without a team are left out."""
    both = usage.join(people, "username").join(teams, "team_id").join(departments, "department_id", "left")
    return both.groupBy("team", "department").agg(F.sum("query_count").alias("total_queries"), F.count("*").alias("usage_row_count"), F.count_distinct("username").alias("user_count"))


def usage_by_app(usage: DataFrame, table_map: DataFrame, schema_map: DataFrame, apps: DataFrame) -> DataFrame:
    """Queries by application, (unmapped) among them. A table's own mapping goes before its schema's; a row counts for every
    application it is mapped to. Maps list few applications a name, so arrays stay short."""
    per = usage.groupBy("object_name").agg(F.sum("query_count").alias("q"))
    t = table_map.groupBy(F.lower("object_name").alias("_t")).agg(F.collect_set("app_id").alias("_ta"))
    s = schema_map.groupBy(F.lower("schema_name").alias("_s")).agg(F.collect_set("app_id").alias("_sa"))
    both = per.join(t, F.lower("object_name") == F.col("_t"), "left").join(s, F.lower(schema_of("object_name")) == F.col("_s"), "left")
    rows = both.select("q", F.explode_outer(F.coalesce("_ta", "_sa")).alias("app_id")).join(apps.select("app_id", "application"), "app_id", "left")
    return rows.groupBy(F.coalesce("application", F.lit("(unmapped)")).alias("application")).agg(F.sum("q").alias("total_queries"))


def entity_context(name: str, usage: DataFrame, table_map: DataFrame, apps: DataFrame, people: DataFrame, teams: DataFrame, departments: DataFrame) -> DataFrame:
    """(role, name, department): applications that own an object, and teams that use it."""
    own = table_map.where(F.lower("object_name") == name.lower()).join(apps, "app_id").select(F.lit("owner").alias("role"), F.col("application").alias("name"), F.lit(None).cast("string").alias("department"))
    use = usage.where(F.lower("object_name") == name.lower()).select("username").distinct().join(people, "username").join(teams, "team_id").join(departments, "department_id", "left")
    return own.distinct().unionByName(use.select(F.lit("user").alias("role"), F.col("team").alias("name"), "department").distinct())


def teams_overview(teams: DataFrame, people: DataFrame, apps: DataFrame) -> DataFrame:
    p, a = people.groupBy("team_id").agg(F.count("*").alias("people")), apps.groupBy(F.col("owner_team_id").alias("team_id")).agg(F.count("*").alias("apps"))
    return teams.join(p, "team_id", "left").join(a, "team_id", "left").na.fill(0, ["people", "apps"])


def apps_overview(apps: DataFrame, table_map: DataFrame, schema_map: DataFrame) -> DataFrame:
    t, s = table_map.groupBy("app_id").agg(F.count_distinct("mapping_id").alias("tables")), schema_map.groupBy("app_id").agg(F.count_distinct("mapping_id").alias("schemas"))
    return apps.join(t, "app_id", "left").join(s, "app_id", "left").na.fill(0, ["tables", "schemas"])


def merge_first(existing: DataFrame, incoming: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows by key, upper-cased: the first incoming row of each, and only where the existing one has no value."""
    up = F.upper(F.col(key))
    fields = [c for c in existing.columns if c != key]
    first = incoming.groupBy(up.alias(key)).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_{c}") for c in fields))
    return existing.withColumn(key, up).join(first, key, "full_outer").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in fields))


def top_teams(usage: DataFrame, people: DataFrame, teams: DataFrame, n: int = 5) -> DataFrame:
    per = usage.join(people, "username").join(teams, "team_id").groupBy("team").agg(F.sum("query_count").alias("total_queries"), F.count_distinct("username").alias("users"))
    return per.orderBy(F.desc("total_queries"), "team").limit(n)


def top_applications(usage: DataFrame, table_map: DataFrame, schema_map: DataFrame, apps: DataFrame, n: int = 5) -> DataFrame:
    """Applications with most queries; usage that no mapping covers is left out."""
    per = usage_by_app(usage, table_map, schema_map, apps).where("application <> '(unmapped)'")
    return per.orderBy(F.desc("total_queries"), "application").limit(n)


def object_search(names: DataFrame, q: str, types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Distinct names(object_name, object_type) that hold q, by lower case; one row over the limit tells that there are more."""
    hit = names.where(F.col("object_name").ilike(f"%{q}%"))
    if types:
        hit = hit.where(F.col("object_type").isin(types))
    return hit.select("object_name").distinct().orderBy(F.lower("object_name"), "object_name").limit(limit + 1)


def global_search(nodes: DataFrame, changes: DataFrame, q: str, each: int = 50, limit: int = 30) -> DataFrame:
    """(kind, name, rank): nodes by name or schema and changes by identifier; exact, prefix, then other matches."""
    like = f"%{q}%"
    n = nodes.where(F.col("object_name").ilike(like) | F.col("schema_name").ilike(like)).select(F.lit("node").alias("kind"), F.col("object_name").alias("name")).distinct().orderBy("name").limit(each)
    c = changes.where(F.col("object_identifier").ilike(like)).select(F.lit("change").alias("kind"), F.col("object_identifier").alias("name")).distinct().orderBy("name").limit(each)
    low = F.lower("name")
    rank = F.when(low == q.lower(), 0).when(F.startswith(low, F.lit(q.lower())), 1).otherwise(2)
    return n.unionByName(c).withColumn("rank", rank).orderBy("rank", "name", "kind").limit(limit)


def list_entities(entities: DataFrame, schema: str | None = None, kind: str | None = None, active_only: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    if schema:
        entities = entities.where(F.lower(schema_of("object_name")) == schema.lower())
    if kind:
        entities = entities.where(F.col("entity_type") == kind)
    if active_only:
        entities = entities.where("is_active")
    return entities.orderBy("object_name", "entity_type").offset(offset).limit(limit).join(F.broadcast(entities.agg(F.count("*").alias("total"))))


def resolve_entity(entities: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """The entity of that upper-cased name, else the first of that name in any case."""
    hit = entities.where(F.lower("object_name") == name.lower())
    if kind:
        hit = hit.where(F.col("entity_type") == kind)
    return hit.orderBy(F.when(F.col("object_name") == name.upper(), 0).otherwise(1), "object_name", "entity_type").limit(1)


def changed_since(tables: DataFrame, ts: Column | str, last: str, created: str) -> DataFrame:
    """Rows whose last change, or creation where there is none, is at ts or later, with a hash over the row."""
    return tables.where(F.coalesce(last, created) >= ts).withColumn("row_hash", F.xxhash64(*tables.columns))
