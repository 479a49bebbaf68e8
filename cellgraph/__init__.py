"""Cell-graph analytics on Spark: detections, links, lineage trees, scores, audits, run records."""
