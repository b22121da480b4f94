"""Range reads of files on any store that Spark reads, as a column.

Python opens only the stores that pyarrow knows. The function here runs in the
executors' JVM and reads through Hadoop's file systems, as Spark's own readers
do. Its class is compiled once for a program, by the compiler that Spark has
for its generated code, and goes to the executors as a jar.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NAME = "tallymark_range"
_CLASS = "tallymark.RangeReader"
_SOURCE = """
package tallymark;

import java.io.IOException;
import org.apache.hadoop.fs.FSDataInputStream;
import org.apache.hadoop.fs.Path;
import org.apache.spark.TaskContext;
import org.apache.spark.sql.api.java.UDF3;
import org.apache.spark.util.SerializableConfiguration;
import org.apache.spark.util.TaskCompletionListener;

/** The last file read stays open until another one is read or the task ends. Threads of a task may share a reader. */
public class RangeReader implements UDF3, TaskCompletionListener {
    private final SerializableConfiguration conf;
    private transient String name;
    private transient FSDataInputStream file;
    private transient boolean listens;

    public RangeReader(SerializableConfiguration conf) {
        this.conf = conf;
    }

    public synchronized Object call(Object path, Object at, Object n) throws Exception {
        if (path == null || at == null || n == null) return null;
        if (!path.equals(name)) {
            close();
            Path p = new Path((String) path);
            file = p.getFileSystem(conf.value()).open(p);
            name = (String) path;
        }
        TaskContext task = TaskContext.get();
        if (task != null && !listens) {
            task.addTaskCompletionListener((TaskCompletionListener) this);
            listens = true;
        }
        byte[] out = new byte[((Number) n).intValue()];
        file.readFully(((Number) at).longValue(), out);
        if (task == null) close();
        return out;
    }

    public synchronized void onTaskCompletion(TaskContext task) {
        try {
            close();
        } catch (IOException e) {
            // what was wanted has been read
        }
    }

    private void close() throws IOException {
        if (file != null) file.close();
        file = null;
        name = null;
    }
}
"""
#: By application: the compiled class, and the folder of its jar, which goes when the program ends.
_COMPILED: dict[str, tuple] = {}


def _compiled(spark: SparkSession):
    jvm, app = spark._jvm, spark.sparkContext.applicationId
    if app not in _COMPILED:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(_SOURCE)
        folder = tempfile.TemporaryDirectory(prefix="tallymark-jar-")
        jar = f"{folder.name}/tallymark-ranges.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(jar)
        _COMPILED[app] = compiler.getClassLoader().loadClass(_CLASS), folder
    return _COMPILED[app][0]


def range_reader(spark: SparkSession) -> Callable[[Column, Column, Column], Column]:
    """``read(file, offset, length)``, the bytes of a range (null if any of them is null), with the session's settings of stores.

    A range that goes beyond its file's end is an error. Rows sorted by file
    open each file once.
    """
    jvm = spark._jvm
    conf = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
    args[0] = conf
    reader = _compiled(spark).getConstructors()[0].newInstance(args)
    spark._jsparkSession.udf().register(_NAME, reader, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return lambda file, at, n: F.call_udf(_NAME, file, at, n)
