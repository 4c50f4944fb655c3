"""Governed carrier-feasibility analytics as Spark DataFrame operators.

``functions``  column expressions (coercion, genotype, disclosure, hashing)
``operators``  DataFrame to DataFrame steps (requests, evidence, counts, release, audit ...)
``sources``    readers and writers (tables, VCF text, variant lists)
``plans``      the whole evaluation, and the driver queries over the test tables
"""
