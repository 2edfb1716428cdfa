"""Training-data operators. Nothing else in the library imports this subpackage.

Modules: ``secret_scan`` ``toxicity`` ``mixing`` ``substring_dedup`` ``jaccard_join`` ``packing``
``gif_media`` ``spot_signatures`` ``reply_trees`` ``resharding``; ``queries`` registers them.
"""
