"""Compressed raster grids as Spark tables.

decode(df) turns a binary column of JPEG 2000 codestreams into images; with_headers,
code_blocks, subbands and block_grid expose what lies between; compare, classify and
errors grade results.
"""

__all__ = ["block_grid", "classify", "code_blocks", "compare", "decode", "errors", "images_to_samples", "subbands", "summarize", "with_headers"]


def __getattr__(name: str):
    """Operators load when first asked for, so Python workers import only what they run."""
    if name in __all__:
        from . import operators

        return getattr(operators, name)
    raise AttributeError(name)
