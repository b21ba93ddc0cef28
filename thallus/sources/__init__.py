from .readers import count_fastq_records, read_feature_table, read_points, read_tsv
from .writers import feature_table_lines, write_fasta, write_feature_table, write_table

__all__ = [
    "count_fastq_records", "read_feature_table", "read_points", "read_tsv",
    "feature_table_lines", "write_fasta", "write_feature_table", "write_table",
]
