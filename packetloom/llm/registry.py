"""The corpus queries and the pipeline as the driver's contract names them."""

import corpus_pipeline
from packetloom.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE = {**queries.ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
