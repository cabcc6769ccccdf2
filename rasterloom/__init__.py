"""An image data engine on Spark: every image or image request is one row of a DataFrame.

Header, geometry, colour, naming and routing logic are native expressions;
pixels are worked on in Arrow batches.  See README.md for a tour.
"""
