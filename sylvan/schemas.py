"""Explicit schemas of the stored tables; nothing is inferred."""

CHUNKS = "doc_id long, index int, text string, start_char_idx int, end_char_idx int"
NODES = "doc_id long, level int, ord int, node_id string, is_leaf boolean, text string, cluster_id int"
EDGES = "doc_id long, parent_id string, child_id string, child_is_leaf boolean, ord int"
MEMBERSHIP = "doc_id long, level int, cluster_id int, node_ord int, probability double"
TREES = "doc_id long, root_id string, levels int, status string"
EMBEDDINGS = "doc_id long, node_id string, embedding array<float>"
DETAIL = "struct<claim:string,verdict:string,reasoning:string>"
VERIFICATION = f"score double, details array<{DETAIL}>, unsupported_claims array<string>, model_name string"
