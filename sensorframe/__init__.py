"""sensorframe: DataFrame-in, DataFrame-out operators for sensor time series and grouped models.

functions/  column expressions (null rules, dates, labels)
operators/  DataFrame operators (cleaning, gap filling, rollups, joins, models)
sources/    readers, writers and schemas
plans/      user-level jobs and reports composed of the operators
"""
