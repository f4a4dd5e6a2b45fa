"""Readers and writers of files that hold grids, and graded corpora."""

from .conformance import check_entries, conformance_bounds, conformance_manifest, corpus_consistent, stream_features
from .files import read_codestreams, read_fixtures
from .grib2 import Grib2Codestreams, grib2_codestreams, split_messages
from .pgx import pgm_images, pgx_images, to_pgm
from .snapshot import SNAPSHOT, read_snapshots, to_snapshots

__all__ = [
    "SNAPSHOT", "Grib2Codestreams", "check_entries", "conformance_bounds", "conformance_manifest", "corpus_consistent", "grib2_codestreams", "pgm_images", "pgx_images",
    "read_codestreams", "read_fixtures", "read_snapshots", "split_messages", "stream_features", "to_pgm", "to_snapshots",
]
