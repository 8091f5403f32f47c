"""Column layouts of the relations that the operators exchange."""

SEQUENCES = "seq_id bigint, label string, letters string, ord bigint"
ALIGNMENT = "msa_id string, seq_id bigint, row string"
CELLS = "msa_id string, seq_id bigint, col bigint, letter string"
POSTERIORS = "set_id string, x bigint, y bigint, pos_x bigint, pos_y bigint, p double"
DISTANCES = "a bigint, b bigint, d double"
TREE = "tree_id bigint, node bigint, parent bigint, label string, length double"
HITS = "query_id bigint, target_id bigint, score double"
