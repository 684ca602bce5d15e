"""Readers and writers of the text formats; plain or .gz, many files at once."""

from .alignments import read_bed, read_gaf, read_paf, read_paths, read_sam, write_bed, write_paf, write_sam
from .fasta import read_fasta, read_fastq, write_fasta
from .gfa import Graph, read_gfa, write_gfa
from .maps import read_map, write_map

__all__ = [
    "Graph", "read_bed", "read_fasta", "read_fastq", "read_gaf", "read_gfa", "read_map", "read_paf", "read_paths", "read_sam",
    "write_bed", "write_fasta", "write_gfa", "write_map", "write_paf", "write_sam",
]
