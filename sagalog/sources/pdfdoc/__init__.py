"""PDF bytes to pages of text and rows of images, in Python workers."""
