"""Table schemas. Every text table is read as strings; typed views cast afterwards."""

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def fields(ddl: str) -> T.StructType:
    """Schema from ``name type, name type``; needs no running session."""
    pairs = (part.strip().split(" ", 1) for part in ddl.split(", "))
    return T.StructType([T.StructField(name, TYPES[kind.strip()]) for name, kind in pairs])


MESSAGES = _strings("id text label scam_type channel source has_url collected_at annotator")
BLOCKED_DOMAINS = _strings("domain source source_url first_seen evidence")
ALLOWED_DOMAINS = _strings("domain note")
TEMPLATES = _strings("id text source source_url first_seen")
REJECTED_DOMAINS = _strings("domain reason rejected_at")
REJECTED_TEMPLATES = _strings("fingerprint reason rejected_at")
MANUAL_SUBMISSIONS = _strings("text source_url note")
CANDIDATES = _strings(
    "id text origin source source_url collected_at hint_label hint_channel suggested_label "
    "suggested_scam_type suggested_channel confidence note"
)
REVIEWED = _strings("key decision decided_at")
MANUAL_MESSAGES = _strings("text label channel source_url note")
SUGGESTIONS = _strings("id label scam_type channel confidence note")
SYNTHETIC = _strings("text label scam_type channel")
DECISIONS = fields(
    "candidate_id string, accept boolean, label string, scam_type string, channel string"
)
INTEL_SOURCES = fields(
    "name string, kind string, url string, category string, enabled boolean, max_items int, "
    "link_pattern string, keywords array<string>"
)
TRAINING_SOURCES = fields(
    "name string, kind string, url string, origin string, enabled boolean, max_items int, link_pattern string, "
    "keywords array<string>, content_class string, license string, text_column string, label_column string, "
    "label_map map<string,string>, channel string"
)
REPORTS = fields(
    "id string, masked_text string, reported_label string, channel string, created_at timestamp"
)
PAGES = fields("page_id bigint, url string, html string")
PREDICTIONS = fields("msg_id bigint, normal double, spam double, scam double")
