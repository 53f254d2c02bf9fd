"""Declared schemas of the engine's datasets; no reader infers one."""

ARTICLE = "outlet string, section string, date string, timestamp string, author string, headline string, url string, article_id string, body string"
ADHOC_ARTICLE = "article_id string, outlet string, url string, date string, author string, genre string, headline string, body string"
LINK = "url string, outlet string, hint string"
WINDOW_PROGRESS = "month string, next_page int, pages int, done boolean"
CHUNK = "article_row long, chunk_no int, doc_id string, date string, outlet string, text string"
CANDIDATE = "source string, target string, polarity string, raw_verb string, speaker string, modality string, quote_span string"
EDGE = "source string, target string, polarity string, valence string, raw_verb string, quote string, doc_id string, phase string, outlet string"
DROP = "edge string, reason string, gate string"
RECORD = f"doc_id string, date string, phase string, outlet string, text string, error string, raw_response string, n_parsed int, edges array<struct<{EDGE.replace(' string', ':string')}>>, drops array<struct<edge:string,reason:string,gate:string>>"
ANNOTATION_KEY = "id string, outlet string, phase string, source string, target string, llm_polarity string, llm_verb string, doc_id string"
ANNOTATION_SHEET = "id string, source string, target string, quote string, headline string, url string, actors_ok string, direction_ok string, polarity string, real_event string, mediation string, notes string"
ARTICLE_COLUMNS = [c.split()[0] for c in ARTICLE.split(", ")]
