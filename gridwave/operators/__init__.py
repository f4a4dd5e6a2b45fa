"""Transformations from codestreams to headers, bands, code-blocks, images and grades."""

from .decode import code_blocks, decode, images_to_samples, with_headers
from .geometry import block_grid, subbands
from .grading import classify, compare, errors, summarize
from .lifting import forward_53, inverse_53, inverse_97, merge_level

__all__ = [
    "block_grid", "classify", "code_blocks", "compare", "decode", "errors", "forward_53", "images_to_samples", "inverse_53", "inverse_97", "merge_level", "subbands", "summarize", "with_headers",
]
