"""Readers: file trees, unified diffs, two versions, result logs, fragments by id."""
