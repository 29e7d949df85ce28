"""Query plans over the test tables: each registered query applies one operator to whole tables."""
