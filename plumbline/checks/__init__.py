"""The eight checks. Each reads roles and knobs, reduces with Spark, and returns one finding."""
