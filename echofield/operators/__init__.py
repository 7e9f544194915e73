"""Operators over cells, detections, points, clusters, tracks and intervals."""
