"""Local files of Hadoop, written without a process for each.

Where its native library is missing, Hadoop's file system for file: starts a
`chmod` process for each folder and file that it makes, with checksums or
without.  Until such a process has become `chmod`, it shares all memory of the
JVM that started it, and whoever adds up the memory of an executor's processes
counts that JVM twice.  The class here sets permissions by a call instead.

It is compiled by Janino, which Spark has for its generated code, and goes to
the executors as a jar of this one class.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

CLASS = "sieveline.LocalFiles"
SOURCE = """
package sieveline;

public class LocalFiles extends org.apache.hadoop.fs.RawLocalFileSystem {
    public void setPermission(org.apache.hadoop.fs.Path path, org.apache.hadoop.fs.permission.FsPermission mode) throws java.io.IOException {
        java.nio.file.Files.setAttribute(pathToFile(path).toPath(), "unix:mode", Integer.valueOf((int) mode.toShort()), new java.nio.file.LinkOption[0]);
    }
}
"""


def local_files(spark: SparkSession) -> str:
    """The name of the class, which from then on the driver and all executors of this context have."""
    context, jvm = spark.sparkContext, spark._jvm
    hadoop = context._jsc.hadoopConfiguration()
    if hadoop.get(CLASS) is None:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(hadoop.getClassLoader())
        compiler.cook(SOURCE)
        # The driver serves the jar to executors whenever they start, so it stays; the temporary folder may be named relative to a process.
        jar = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sieveline-")), "local_files.jar")
        with zipfile.ZipFile(jar, "w") as z:
            z.writestr(CLASS.replace(".", "/") + ".class", bytes(compiler.getBytecodes()[CLASS]))
        context._jsc.addJar(jar)
        hadoop.setClassLoader(compiler.getClassLoader())
        hadoop.set(CLASS, jar)
    return CLASS
