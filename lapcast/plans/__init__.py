"""Physical-layout helpers and whole pipelines."""
