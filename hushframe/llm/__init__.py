"""Operations of large training-data pipelines, each one operator with its own query."""
