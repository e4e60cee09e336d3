"""The relations, as DDL.

Everything carries ``query_id``; order that results depend on is a column.
An entity's cells are an array in the order of its plan's columns, so what
looks at one entity is a projection, and only what compares entities moves rows.
"""

#: ``source_regime`` is the kind of the source by address and title alone.
CELL = "col string, value string, source_url string, source_title string, evidence_snippet string, confidence double, source_regime string"
CELLS = "array<struct<" + ", ".join(": ".join(x.split(" ")) for x in CELL.split(", ")) + ">>"
DRAFTS = f"query_id string, draft_seq long, entity_name string, source_url string, source_title string, cells {CELLS}"
ENTITIES = f"query_id string, row_pos long, entity_id string, sources_count long, aggregate_confidence double, canonical_domain string, cells {CELLS}"
QUERIES = "query_id string, query string"
HITS = "query_id string, angle_pos int, hit_pos int, url string, title string, snippet string"
ITEM = "type array<string>, name string, url string, telephone string, description string, priceRange string, servesCuisine string, address string, offers string"
METADATA = (
    "anchor_count int, headings array<string>, json_ld_types array<string>, meta_description string, mailto_links array<string>, "
    f"script_count int, structured_data array<struct<{ITEM}>>, tel_links array<string>, title string, "
    "anchors array<struct<text: string, href: string, parent_text: string>>, visible string"
)
EVENTS = "job_id string, seq long, ts timestamp, status string, phase string, query string, result string, error string"
