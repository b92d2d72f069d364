"""Resumable iteration as Structured Streaming: packers that carry their buffers, cluster draws that carry their cursors, loader state tables."""
