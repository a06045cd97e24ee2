"""Source-code risk analytics on Spark: files in, ranked findings, scores and reports out.

Start with ``riskloom.plans.scan``: ``scan(files)`` and ``repository_scores(findings)``.
"""
