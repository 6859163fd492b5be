"""All registered queries outside the training-data subpackage, with their SQL."""

from . import q_changes, q_context, q_dates, q_emotion, q_evidence, q_functions, q_linking, q_model, q_recall, q_review, q_screening, q_sources, q_state, q_streaming, q_tables, q_upkeep

PARTS = [q_recall, q_tables, q_linking, q_emotion, q_streaming, q_review, q_upkeep, q_model, q_dates, q_state, q_screening, q_evidence, q_context, q_functions, q_sources, q_changes]
QUERIES: dict = {name: query for part in PARTS for name, query in part.Q.items()}
ORACLE_SQL: dict = {name: text for part in PARTS for name, text in part.S.items()}
