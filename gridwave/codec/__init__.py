"""The codestream arithmetic, free of Spark: it runs inside Arrow-batched functions."""
