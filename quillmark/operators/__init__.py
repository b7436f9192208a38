"""quillmark.operators"""
