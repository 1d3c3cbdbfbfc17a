"""Tables in; graphs, models and fits out as text."""
