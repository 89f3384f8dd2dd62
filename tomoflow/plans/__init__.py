"""The declarative pipeline: model, parsing, checks, rewrites, stages and costs."""
