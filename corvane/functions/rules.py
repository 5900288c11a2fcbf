"""Rule tables and the column expressions made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capitalized

# Annotation patterns and their roles, in order; True asks for the whole token.
ROLES = (
    ("restcontroller", "controller", False),
    ("controller", "controller", False),
    ("resource", "controller", True),
    ("endpoint", "controller", False),
    ("route", "controller", False),
    ("requesthandler", "controller", False),
    ("lambdahandler", "controller", False),
    ("handler", "controller", True),
    ("listener", "listener", False),
    ("consumer", "listener", False),
    ("subscriber", "listener", False),
    ("repository", "repository", False),
    ("dao", "repository", False),
    ("service", "service", False),
)
# Dependency keywords, types and technologies, in order; s3 asks for token boundaries.
EXTERNALS = (
    ("postgresql", "Database", "PostgreSQL"),
    ("mysql", "Database", "MySQL"),
    ("ojdbc", "Database", "Oracle"),
    ("sqlite", "Database", "SQLite"),
    ("h2database", "Database", "H2"),
    ("kafka", "Message Broker", "Apache Kafka"),
    ("rabbitmq", "Message Broker", "RabbitMQ"),
    ("amqp", "Message Broker", "RabbitMQ"),
    ("redis", "Cache", "Redis"),
    ("jedis", "Cache", "Redis"),
    ("lettuce", "Cache", "Redis"),
    ("memcached", "Cache", "Memcached"),
    ("elasticsearch", "Search Engine", "Elasticsearch"),
    ("opensearch", "Search Engine", "OpenSearch"),
    ("s3", "Object Storage", "S3"),
    ("minio", "Object Storage", "S3"),
)
S3_PATTERN = "(?i)(?:^|[^a-z])s3(?:$|[^a-z0-9])"
EXTERNAL_LABELS = {
    "Database": "Reads/writes data in",
    "Message Broker": "Publishes/consumes messages via",
    "Cache": "Caches data in",
    "Search Engine": "Indexes/queries",
    "Object Storage": "Stores objects in",
}
ROLE_LABELS = {"controller": "REST Controller", "listener": "Message Listener", "repository": "Repository", "service": "Service"}
ROLE_DESCRIPTIONS = {
    "controller": "REST API controller for ",
    "service": "Business logic service for ",
    "repository": "Data access layer for ",
    "listener": "Message listener for ",
}
# Framework patterns over lower-case dependency names, in order.
FRAMEWORKS = (
    ("spring-boot", "Spring Boot"),
    ("spring-web", "Spring MVC"),
    ("^fastapi$", "FastAPI"),
    ("^flask$", "Flask"),
    ("^django", "Django"),
    ("^express$", "Express"),
    ("^nestjs", "NestJS"),
    ("^gin$", "Gin"),
    ("^actix", "Actix"),
)


def token_role(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, role, exact in reversed(ROLES):
        out = F.when(token == pattern if exact else F.contains(token, F.lit(pattern)), role).otherwise(out)
    return out


def role(annotations: Column) -> Column:
    """Role of a comma-separated list: that of the first token with one; within a token the first pattern."""
    roles = F.transform(F.split(F.lower(annotations), ","), lambda t: token_role(F.trim(t)))
    return F.get(F.filter(roles, lambda r: r.isNotNull()), 0)


def external_rule(name: Column) -> Column:
    """Index of the first external-system rule that a dependency's name matches, or null."""
    out = F.lit(None).cast("int")
    for i, (keyword, _, _) in reversed(list(enumerate(EXTERNALS))):
        hit = name.rlike(S3_PATTERN) if keyword == "s3" else F.contains(F.lower(name), F.lit(keyword))
        out = F.when(hit, i).otherwise(out)
    return out


def _pick(index: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def external_type(index: Column) -> Column:
    return _pick(index, [r[1] for r in EXTERNALS])


def external_technology(index: Column) -> Column:
    return _pick(index, [r[2] for r in EXTERNALS])


def mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _matches(pattern: str):
    return lambda value: value.rlike(pattern)


def framework(deps: Column) -> Column:
    """The first framework, in the table's order, that any dependency matches."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(FRAMEWORKS):
        out = F.when(F.exists(F.transform(deps, F.lower), _matches(pattern)), name).otherwise(out)
    return out


def technology(language: Column, deps: Column) -> Column:
    return F.concat(capitalized(language), F.coalesce(F.concat(F.lit(" / "), framework(deps)), F.lit("")))


def component_technology(annotations: Column, own_framework: Column, language: Column) -> Column:
    found = role(annotations)
    labelled = F.concat(capitalized(language), F.lit(" "), mapped(found, ROLE_LABELS))
    return F.coalesce(F.when(found.isNotNull(), labelled), F.nullif(own_framework, F.lit("")), capitalized(language))


def role_description(name: Column, annotations: Column) -> Column:
    found = role(annotations)
    return F.coalesce(F.concat(mapped(found, ROLE_DESCRIPTIONS), name), F.concat(name, F.lit(" module")))


def relationship_label(source_role: Column, target_role: Column) -> Column:
    return F.when(source_role == "controller", "Delegates to").when(target_role == "repository", "Persists via").otherwise("Uses")
