"""Explicit schemas of the engine's tables; nothing is inferred."""

FILES = "source string, date date, file_name string, path string, sha256 string, content string, error string, title string, stated_date date"
ITEMS = (
    "source string, date date, file_name string, section_ord int, section_title string, category string, item_ord int, "
    "text string, time string, line_start int, line_end int, skip_extraction boolean, tag string"
)
MENTIONS = (
    "id string, type string, name string, summary string, status string, source string, date date, file_name string, "
    "section_ord int, section_title string, item_ord int, nth int, source_line string"
)
ENTITIES = (
    "id string, type string, name string, summary string, importance double, first_seen date, last_seen date, day_count bigint, "
    "source_lines array<string>, metadata map<string,string>"
)
RELATIONS = "id string, from_entity string, to_entity string, rel_type string, weight double, evidence string"
MANIFEST = "date date, source string, file_name string, sha256 string, entity_count bigint, processed_at timestamp, status string, title string"
ACCESS_LOG = "entity_id string, tool string, query string, accessed_at timestamp"
LINKS = "source string, file_name string, from_entity string, to_entity string, rel_type string, weight double, evidence string"
POSTINGS = "entity_id string, field string, term string, tf bigint, positions array<int>, len bigint"
VECTORS = "entity_id string, embedding array<float>"
