"""Controlled vocabularies.  Everything in this file is a fixed value."""

from __future__ import annotations

# Edge label weights for distances.
EDGE_WEIGHTS = {
    "calls": 1.0,
    "exposes": 1.0,
    "depends_on": 0.5,
    "publishes_to": 1.5,
    "consumes_from": 1.5,
    "evidence_of": 0.25,
}
DEFAULT_EDGE_WEIGHT = 1.0

# Edge labels that count as calls.
CALL_EDGE_TYPES = ("calls", "invokes", "triggers", "publishes", "subscribes", "depends_on")

# Path parts that never name a component.
GENERIC_PATH_PARTS = (
    "", ".", "..", "__pycache__", "src", "source", "app", "apps", "services", "service",
    "modules", "module", "lib", "libs", "code", "dist", "build", "bin", "config",
)

# Files and folders left out of a scan.
SKIP_FILE_NAMES = (
    ".whitesource", ".whitesource.config", ".whitesource.config.json", ".ds_store", "thumbs.db", "desktop.ini",
)
SKIP_FILE_PREFIX = ".git"
SKIP_FILE_SUFFIX = ":Zone.Identifier"
SKIP_DIRS = (
    ".git", ".github", ".hg", ".svn", ".venv", "node_modules", "out", "dist", "build", "__pycache__", ".mypy_cache",
)

# Language by extension, code and infra extensions.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".cs": "csharp", ".java": "java",
    ".go": "go", ".rb": "ruby", ".php": "php", ".tf": "terraform", ".bicep": "bicep", ".yaml": "yaml",
    ".yml": "yaml", ".json": "json",
}
CODE_EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".cs", ".java", ".go", ".rs", ".rb", ".php")
INFRA_EXTENSIONS = (".bicep", ".tf", ".yaml", ".yml", ".json")

# Identifier suffixes, datastore and service kind hints.
IDENTIFIER_SUFFIXES = ("id", "key", "code", "number", "guid", "token")
DATASTORE_KIND_HINTS = ("db", "sql", "table", "cosmos", "storage", "postgres", "mysql", "mongo")
SERVICE_KIND_HINTS = ("queue", "servicebus", "topic", "event", "http", "api")

# Connector prefix -> roles, substring semantics.
SUBSTRING_ROLES = {
    "http": ("interface.receive", "interface.reply"),
    "rest": ("interface.receive", "interface.reply"),
    "soap": ("interface.receive", "interface.reply"),
    "function": ("interface.receive",),
    "process": ("invoke.process",),
    "bw": ("invoke.process",),
    "callprocess": ("invoke.process",),
    "jdbc": ("data.jdbc",),
    "sql": ("data.jdbc",),
    "jms": ("messaging.jms",),
    "kafka": ("messaging.jms",),
    "mapper": ("transform.mapper",),
    "timer": ("schedule.timer",),
    "cron": ("schedule.timer",),
    "log": ("ops.log",),
    "file": ("ops.log",),
    "error": ("error.throw",),
}

# Connector prefix (before a colon) -> roles, exact semantics.
PREFIX_ROLES = {
    "http": ("interface.receive", "interface.reply"),
    "rest": ("interface.receive", "interface.reply"),
    "soap": ("interface.receive", "interface.reply"),
    "api": ("interface.receive", "interface.reply"),
    "trigger": ("interface.receive",),
    "process": ("invoke.process",),
    "bw": ("invoke.process",),
    "logicapps": ("invoke.process",),
    "azure": ("invoke.process",),
    "pb": ("invoke.process",),
    "jdbc": ("data.jdbc",),
    "sql": ("data.jdbc",),
    "jms": ("messaging.jms",),
    "sb": ("messaging.jms",),
    "mapper": ("transform.mapper",),
    "timer": ("schedule.timer",),
    "schedule": ("schedule.timer",),
    "log": ("ops.log",),
    "trace": ("ops.log",),
    "error": ("error.throw",),
    "exception": ("error.throw",),
}

# Whole connector name -> roles.
CONNECTOR_ROLES = {
    "pb:ui_event": ("interface.receive",),
    "pb:method_entry": ("invoke.process",),
    "pb:method_call": ("invoke.process",),
    "pb:db_exec": ("data.jdbc",),
    "pb:datawindow_op": ("data.jdbc",),
    "pb:datawindow_sql": ("data.jdbc",),
    "pb:http_request": ("interface.receive", "interface.reply"),
    "pb:soap_call": ("interface.receive", "interface.reply"),
    "pb:ribbon_event": ("interface.receive",),
    "pb:external_function": ("invoke.process",),
    "pb:workflow": ("invoke.process",),
}

# Import name part -> integration kind; the first hit in this order wins.
INTEGRATION_HINTS = {
    "axios": "http_client",
    "node-fetch": "http_client",
    "@microsoft/microsoft-graph-client": "microsoft_graph",
    "@azure": "azure_sdk",
    "@azure/storage-blob": "azure_storage",
    "aws-sdk": "aws_sdk",
    "pg": "postgres",
    "mysql2": "mysql",
    "mssql": "sql_server",
    "redis": "redis",
    "mongodb": "mongodb",
    "mongoose": "mongodb",
    "twilio": "communication",
    "sendgrid": "communication",
    "mailchimp": "marketing",
    "System.Net.Http": "http_client",
    "Microsoft.PowerPlatform": "power_platform",
    "Microsoft.Graph": "microsoft_graph",
    "System.Data.SqlClient": "sql_server",
    "MongoDB.Driver": "mongodb",
    "Azure.Storage.Blobs": "azure_storage",
    "SendGrid": "communication",
}

# Component name parts dropped, and role words with their labels.
COMPONENT_STOPWORDS = (
    "component", "page", "view", "screen", "card", "dialog", "modal", "form", "container", "module", "section",
    "area", "widget",
)
ROLE_KEYWORDS = {
    "admin": "Administrator", "administrator": "Administrator", "manager": "Manager", "mgr": "Manager",
    "customer": "Customer", "client": "Client", "partner": "Partner", "vendor": "Vendor", "analyst": "Analyst",
    "agent": "Agent", "operator": "Operator", "ops": "Operations", "support": "Support", "finance": "Finance",
    "billing": "Billing", "sales": "Sales", "approver": "Approver", "reviewer": "Reviewer", "owner": "Owner",
    "lead": "Lead",
}

# Worklist bands (minimum score, priority, label).
PRIORITY_BANDS = ((15, 1, "high"), (8, 2, "medium"))
LOWEST_BAND = (4, "low")

# HTTP verbs an API description may hold.
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")

# Operation -> CRUD class, target kind -> protocol.
CRUD_BY_OPERATION = {
    "reads": "read", "writes": "update", "deletes": "delete", "invokes": "execute", "calls": "execute",
}
PROTOCOL_BY_KIND = {
    "http": "https", "workflow": "https", "sql": "sql", "dataverse": "dataverse", "sharepoint": "sharepoint",
}
